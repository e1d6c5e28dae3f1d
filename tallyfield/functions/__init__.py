"""Column to Column functions; all native expressions."""
