"""Sources of the graph engine."""
