"""tarkib: a Spark-native engine for multi-script text data: normalise, look up, vote, align, scan, order and score.

``functions`` are column expressions and Arrow UDFs, ``operators`` transforms of DataFrames, ``sources`` readers and
writers, ``streaming`` resumable updates, ``plans`` the registered queries with their SQL twins. Operators for training
data stand apart in a subpackage of their own.
"""
