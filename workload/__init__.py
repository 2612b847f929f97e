"""Queries over the driver's tables, their oracle SQL, and the corpus both of them read."""
