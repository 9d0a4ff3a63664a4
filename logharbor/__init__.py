"""Log analytics and incident detection as Spark DataFrame and streaming jobs."""
