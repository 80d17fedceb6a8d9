"""Model-evaluation and trust analytics as Spark DataFrame jobs."""
