"""Streaming counts."""
