"""operators of the temporal graph engine."""
