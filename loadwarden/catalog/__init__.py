"""Named queries over the given tables."""
from loadwarden.catalog import drift, fixes, gates, incidents, models, releases, profiles, quality, streams  # noqa: F401
from loadwarden.catalog.registry import ORACLES, QUERIES  # noqa: F401
