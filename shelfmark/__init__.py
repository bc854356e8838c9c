"""Document retrieval, metric facts and conversation-log analytics as Spark jobs."""
