"""Physical-plan helpers: lineage cuts, scratch tables, distributed ranks."""
