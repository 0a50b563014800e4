"""adjset: directed adjacency sets on Spark DataFrames.

The core never imports :mod:`adjset.llm`, the subpackage for training-data operators.
"""

__version__ = "0.1.0"
