"""Document-question analytics on Spark: DataFrame operators, readers, writers and streams."""
