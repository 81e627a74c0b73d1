"""Point-in-time event analytics as PySpark operators."""
