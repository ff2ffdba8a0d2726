"""Imports every query module, so that all queries are registered."""

from ledgerwatch.plans import catalogue, features, modelling, profiles, scoring  # noqa: F401
from ledgerwatch.plans.base import QUERIES, SQL  # noqa: F401
