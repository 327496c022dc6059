"""loadwarden - load-aware schema-drift detection, gating and marts as Spark DataFrame jobs."""

__version__ = "0.1.0"
