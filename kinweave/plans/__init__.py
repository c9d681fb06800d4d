"""Plan-level helpers: shared scratch tables that cut lineage."""
