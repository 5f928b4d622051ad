"""Spark operators that audit which tokens a fine-tuning corpus supervises."""

__version__ = "0.1.0"
