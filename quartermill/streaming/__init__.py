"""Structured Streaming extensions; the batch plans have no streams."""
