"""Training-data pipeline operators (text, vectors, packing) on Spark.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it can be imported.
"""
