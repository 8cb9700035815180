"""Pure functions from bytes to values and back; nothing here knows Spark."""
