"""Column functions; all are native expressions."""
