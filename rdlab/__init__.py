"""Codec-trial analytics on Spark."""
