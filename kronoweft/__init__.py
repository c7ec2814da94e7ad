"""kronoweft: bitemporal facts, property graphs and vectors on Spark DataFrames."""

__version__ = "0.1.0"
