"""Scans, landing, versioned tables, the generator and the adapter of the driver's tables."""
