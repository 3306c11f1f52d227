"""Land overlay and corpus jobs as plain Spark DataFrame code."""
