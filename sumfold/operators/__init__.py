"""Factors, relations, matrices, graphs, and the problems solved with them."""
