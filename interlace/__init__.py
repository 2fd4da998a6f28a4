"""Affiliation panels on Spark: who is tied to which organisation, wave after wave."""
