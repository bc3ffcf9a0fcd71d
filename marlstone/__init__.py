"""Composable PySpark transforms for product-catalogue and review data."""

__version__ = "0.1.0"
