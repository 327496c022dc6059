"""Compositions of operators: marts, scans of new loads, releases."""
