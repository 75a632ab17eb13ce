"""Importing this module registers every query."""

from docspend.plans import functions, further, ingest, relational, searching, statistics, streams  # noqa: F401
from docspend.plans.registry import ORACLES, QUERIES  # noqa: F401
