"""Sources of the voyage engine."""
