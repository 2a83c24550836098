"""Retrieval, question answering and corpus preparation as Spark jobs."""
