"""Contexts, workflows and experiments."""

from tidemark.plans.context import ProblemContext, TimeSlicer

__all__ = ["ProblemContext", "TimeSlicer"]
