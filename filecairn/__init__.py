"""File-inventory and duplicate analysis expressed as Spark DataFrame jobs."""
