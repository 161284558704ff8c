"""Views that give the driver's tables the shape of series."""
