"""Panel analytics on Spark: time-series panels as DataFrame, window and streaming programs."""
