"""Event, trial and signal analytics on Spark."""
