"""The registered queries, one or more for each operator."""

from parcelcover.queries import layers, measures, parcels, pixels, portfolio, scalars  # noqa: F401
from parcelcover.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
