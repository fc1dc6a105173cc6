"""functions of the plotline package."""
