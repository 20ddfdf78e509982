"""Developer-activity analytics as PySpark DataFrame operators."""
