"""Importing this registers every query."""

from lineforge.workload import (  # noqa: F401
    checks,
    jobs,
    learning,
    models,
    projections,
    relational,
    scans,
)
from lineforge.workload.registry import FIXTURES, ORACLES, QUERIES  # noqa: F401
