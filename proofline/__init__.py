"""Proofline: evidence analytics as pure PySpark DataFrame operators."""
