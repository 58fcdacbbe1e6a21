"""Case analytics on Spark: DataFrame in, DataFrame out, column names as parameters."""
