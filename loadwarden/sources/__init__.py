"""Where rows come from: bronze loads, lineage, registries, control-plane tables, build results."""
