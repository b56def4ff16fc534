"""Feature engineers, candidates, scores, policies, searches, representations, diagnostics."""
