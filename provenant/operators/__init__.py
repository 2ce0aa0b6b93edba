"""Relational and statistical operators on citation tables."""
