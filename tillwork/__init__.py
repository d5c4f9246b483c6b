"""Retail operations analytics as PySpark DataFrame operators."""
