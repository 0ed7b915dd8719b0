"""Readers for season CSV, nested match JSON, name maps, match tables and documents."""
