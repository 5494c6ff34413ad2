"""sources of the temporal graph engine."""
