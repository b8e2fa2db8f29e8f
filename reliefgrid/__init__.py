"""Destination-pressure and dispersal analytics as Spark DataFrame operators."""
