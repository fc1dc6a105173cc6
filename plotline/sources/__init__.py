"""sources of the plotline package."""
