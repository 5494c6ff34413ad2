"""streaming of the temporal graph engine."""
