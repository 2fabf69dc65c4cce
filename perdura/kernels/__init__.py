"""Vectorised numpy kernels; each takes a matrix of series (rows) and gives a value per row."""
