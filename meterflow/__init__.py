"""meterflow: smart-plug electricity analytics expressed as Spark DataFrames and streams."""
