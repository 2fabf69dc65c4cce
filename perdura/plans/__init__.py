"""Plans: manifests, the runner, and the registered queries with their SQL."""
