"""Vellumine: document analytics on Apache Spark."""
