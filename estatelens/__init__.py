"""Evidence analytics for large code estates as Spark jobs."""
