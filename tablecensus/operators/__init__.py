"""DataFrame operators: listing, usage, lineage, lifecycle."""
