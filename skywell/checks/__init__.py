"""Queries over the given tables, each with the SQL that must agree with it."""

from skywell.checks import cleaning, joining, mining, pipelines, reports, scalar, scoring, storage, streams, windows  # noqa: F401
from skywell.checks.base import QUERIES, SQL  # noqa: F401
