"""Market-bar analytics as Spark DataFrame functions."""
