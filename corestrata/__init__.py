"""A Spark engine for content-defined chunks."""
