"""Text governance and compensation analytics as Spark jobs."""
