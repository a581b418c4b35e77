"""All registered queries."""

from workloads import (  # noqa: F401
    cleaning, dashboards, duplicates, files, fitting, private, profiling, scores, synthetic,
    templates,
)
from workloads.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
