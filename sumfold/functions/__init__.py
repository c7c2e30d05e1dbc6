"""Scalar algebra: semirings as Column expressions, and small integer helpers."""
