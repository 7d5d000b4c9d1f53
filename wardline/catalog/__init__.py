"""Named queries over the bundled tables, each with the SQL that checks it."""

from wardline.catalog import cohorts, evaluation, histories, joins, modelling, scalars, scans, statistics  # noqa: F401
from wardline.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
