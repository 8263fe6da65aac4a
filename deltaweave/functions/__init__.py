"""Scalar functions, as Spark columns where Spark can express them."""
