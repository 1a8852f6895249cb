"""sessionlab: session-log analytics and per-visitor scoring on PySpark DataFrames."""

__version__ = "0.1.0"
