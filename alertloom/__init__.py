"""Point-in-time event-history analytics on Spark."""
