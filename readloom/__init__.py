"""PySpark-native operators for sequencing, variant, interval and large text data.

Every operator is a function from DataFrames to a DataFrame; nothing is
collected unless its size is bounded by a documented parameter.
"""

__version__ = "0.1.0"
