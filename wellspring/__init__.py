"""wellspring: Spark-native analytics for high-content screens.

Every operator takes and returns DataFrames and can be chained through ``DataFrame.transform``.
"""
