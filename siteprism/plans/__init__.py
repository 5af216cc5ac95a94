"""Queries over the driver tables: inputs, plans and their SQL twins."""
