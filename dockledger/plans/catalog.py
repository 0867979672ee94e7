"""All registered queries."""

from dockledger.plans import dataflows, models, normalization, preparation, scorecards  # noqa: F401
from dockledger.plans.registry import QUERIES

__all__ = ["QUERIES"]
