"""Query plans registered with the driver contract (``__spark_entry__``)."""
