"""Customer-review and venue-operations analytics as PySpark DataFrame jobs."""
