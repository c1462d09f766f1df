"""Retrieval and rule analytics on Spark."""
