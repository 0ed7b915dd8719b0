"""The registered queries, their input derived from the given tables, and their oracle SQL."""
