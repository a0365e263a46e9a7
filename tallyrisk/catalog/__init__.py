"""Registered queries: each operator on the supplied tables, next to SQL that states the same result."""

from tallyrisk.catalog import cleaning, encoding, evaluation, features, fitted, joins, logs, models, scoring, sources, streams
from tallyrisk.catalog import aggregates, drift, windows
from tallyrisk.catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
