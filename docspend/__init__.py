"""docspend: document intake and spend analytics as Spark jobs."""
