"""firnline: tiered tables and their SQL surface on Spark.

Recent rows stay in a small hot store, older rows settle into immutable
Parquet segments, and every reader sees one consistent latest state.
"""

__version__ = "0.1.0"
