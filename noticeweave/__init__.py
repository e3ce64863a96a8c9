"""Notice analytics on Spark: DataFrame operators over published notices."""
