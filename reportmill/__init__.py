"""reportmill: incident-report analytics as PySpark DataFrame jobs."""
