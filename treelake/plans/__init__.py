"""All registered queries and their SQL."""

from . import queries, reports, round_trips, steps  # noqa: F401  (steps adds its own to those of queries)

QUERIES = {**queries.QUERIES, **reports.QUERIES, **round_trips.QUERIES}
ORACLE = {**queries.ORACLE, **reports.ORACLE, **round_trips.ORACLE}
