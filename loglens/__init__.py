"""loglens: log analytics on PySpark."""
