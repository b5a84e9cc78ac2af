"""Frame-by-frame state."""
