"""Registered queries over the driver tables and the SQL they are checked against."""

from reliefgrid.plans.registry import oracles, queries  # noqa: F401
