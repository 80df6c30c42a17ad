"""Spark operators for word spaces, rating studies, topic models and norms."""
