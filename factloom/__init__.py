"""Verifiable-facts analytics on PySpark."""
