"""Column-level functions: types, identifiers, statistics, text."""
