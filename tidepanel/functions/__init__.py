"""Part of the panel engine."""
