"""Column expressions for series in Catalyst."""
