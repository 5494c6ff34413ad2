"""functions of the temporal graph engine."""
