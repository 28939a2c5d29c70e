"""Versioned snapshot analytics on Spark."""
