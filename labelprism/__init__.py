"""labelprism: statistical analysis of labelled text and embeddings on Spark.

Every operator is a function from DataFrame(s) to DataFrame built from Spark SQL
expressions, joins, aggregations and windows, or from ``pyspark.ml`` estimators.
"""

__version__ = "0.1.0"
