"""plans of the temporal graph engine."""
