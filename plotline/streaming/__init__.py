"""streaming of the plotline package."""
