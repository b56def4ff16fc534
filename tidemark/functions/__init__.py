"""Numerical kernels for Arrow batches."""

from tidemark.functions.kernels import dtw_abs, dtw_multivariate, nonnegative_weights, simplex_weights

__all__ = ["dtw_abs", "dtw_multivariate", "nonnegative_weights", "simplex_weights"]
