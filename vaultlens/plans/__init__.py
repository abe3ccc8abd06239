"""Plan-level helpers: counting rows, scratch tables, skew measures, named queries."""
