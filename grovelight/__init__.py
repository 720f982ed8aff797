"""Spark-native clustering, tree scoring and reduction-quality analytics for labelled vectors."""
