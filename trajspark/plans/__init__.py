"""Query catalogue: trajectory operators applied to the driver's tables."""
