"""Panel time-series analytics on Spark.

A panel is many segments, each with one time series.  Every public
operator is a function from DataFrame to DataFrame built from Spark SQL
built-ins, so Catalyst plans the work and it scales with the cluster.
"""

__version__ = "0.1.0"
