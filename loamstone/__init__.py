"""loamstone: a Spark-first engine for building and querying text knowledge bases."""

__version__ = "0.1.0"
