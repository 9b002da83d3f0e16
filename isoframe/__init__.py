"""isoframe: evaluated and experimental nuclear data as Spark DataFrames."""

__version__ = "0.1.0"
