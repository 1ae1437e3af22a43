"""prismal: data profiling, cleaning, exploration, statistics and modelling on Spark DataFrames."""

__version__ = "0.1.0"
