"""Registered queries."""

from almanac.plans import catalogue, landing, streams, texts  # noqa: F401
from almanac.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
