"""modalframe: cohort building, multimodal features and per-pattern score correction on Spark DataFrames."""

__version__ = "0.1.0"
