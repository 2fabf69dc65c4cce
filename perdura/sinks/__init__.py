"""Where results go: result store, report tables, renderings and their contract."""
