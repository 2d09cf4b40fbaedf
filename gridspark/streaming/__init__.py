"""Formula columns over streams."""
