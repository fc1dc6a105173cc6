"""operators of the plotline package."""
