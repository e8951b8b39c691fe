"""Annotated-text graph analytics on Spark."""
