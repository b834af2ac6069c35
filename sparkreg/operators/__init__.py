"""Operators: profiling, encoders, folds, estimators, blending and metrics."""
