"""Data-quality profiling on Spark."""
