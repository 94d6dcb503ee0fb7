"""Corpus retrieval, citation checking and training-data operators on Spark DataFrames.

Every operator is ``f(DataFrame, ...) -> DataFrame``: it declares a plan and leaves
its execution to Spark.  Import the subpackages you need; importing this package
starts nothing.
"""

__version__ = "0.1.0"
