"""Package of the indel engine."""
