"""Readers, the canonical ownership tables and writers."""
