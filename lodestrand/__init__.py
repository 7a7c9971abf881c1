"""lodestrand: full-text search, change-feed mirroring and table maintenance on Spark DataFrames."""

__version__ = "0.1.0"
