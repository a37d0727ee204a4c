"""Plan-level helpers: lineage cutting, the fixpoint driver and the query registry."""
