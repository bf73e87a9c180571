"""textloom: corpus analytics as Spark jobs."""
