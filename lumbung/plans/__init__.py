"""Query plans registered in __spark_entry__.py."""
