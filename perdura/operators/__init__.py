"""Stages over DataFrames: simulate, perturb, estimate, evaluate, aggregate, rank."""
