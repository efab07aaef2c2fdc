"""Registered queries: each a Spark query over the driver's tables, with its SQL equivalent."""

from termweave.catalog import cleaning, dictionaries, enrichment, extraction, graphs, modelling, roundtrips, scanning, shaping, vectors  # noqa: F401
from termweave.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
