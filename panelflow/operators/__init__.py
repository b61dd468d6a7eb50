"""Panel operators: DataFrame -> DataFrame functions over Spark built-ins."""
