"""Where series come from: tables, files, inline values and generator grids."""
