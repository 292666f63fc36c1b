"""PDF bytes to objects and back, without Spark."""
