"""Scalar rules: value typing, dialects, scores and number formats."""
