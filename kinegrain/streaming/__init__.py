"""Streaming forms of track building."""
