"""The driver's queries: operators applied to the driver's tables."""
