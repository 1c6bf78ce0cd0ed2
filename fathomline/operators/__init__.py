"""Operators of the voyage engine."""
