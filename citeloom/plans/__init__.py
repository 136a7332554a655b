"""Plan helpers: lineage cuts and iteration."""
