"""Sequential bit streams, read in Python one slice at a time."""
