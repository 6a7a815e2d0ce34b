"""Structured Streaming form of the play statistics."""
