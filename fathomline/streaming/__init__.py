"""Streaming of the voyage engine."""
