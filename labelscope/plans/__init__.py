"""Corpus adapters and end-to-end plans."""
