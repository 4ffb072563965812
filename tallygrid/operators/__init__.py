"""The operations on counts, weather and calendar, one module per family."""
