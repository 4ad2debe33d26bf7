"""Document-corpus analytics on Spark: composable DataFrame functions."""
