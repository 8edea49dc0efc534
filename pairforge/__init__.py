"""Build and measure corpora of sentence pairs on Spark."""

__version__ = "0.1.0"
