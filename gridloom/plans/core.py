"""All registered queries of the library itself."""

from gridloom.plans import folds, streams, terrain_heat, zonal  # noqa: F401
from gridloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
