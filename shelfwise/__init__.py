"""shelfwise: retail recommendation analytics as plain PySpark DataFrame jobs."""
