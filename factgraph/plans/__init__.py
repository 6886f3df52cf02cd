"""Plans over several operators: bindings to tables, lineage control, the temporal graph API."""
