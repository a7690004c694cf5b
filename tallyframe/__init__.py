"""Spark-native analytics for evaluating and ranking predictive models."""
