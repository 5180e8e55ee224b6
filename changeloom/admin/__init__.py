"""Part of the change-data engine: admin."""
