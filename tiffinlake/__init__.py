"""Tiffinlake: a food-delivery warehouse expressed as Spark DataFrame operators."""

__version__ = "0.1.0"
