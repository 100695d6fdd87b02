"""Offset-exact span analytics on Spark."""
