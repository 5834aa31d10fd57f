"""Where queries register, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palate.sources.views import VIEWS, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The fixed clock of all queries, later than the last event.
ASOF = "2001-12-01 00:00:00"

#: Further common table expressions of the oracle; each may use the ones before it and the views.
PARTS: dict[str, str] = {}


def asof() -> Column:
    return F.lit(ASOF).cast("timestamp_ntz")


def query(name: str, uses: str = "", sql: str | None = None, stored: bool = False):
    """Register a function of Views under a name; uses: the views and parts that sql needs, in order; stored: see Views."""

    def register(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir, stored))
        if sql:
            named = [f"{n} as ({VIEWS.get(n) or PARTS[n]})" for n in uses.split()]
            ORACLE_SQL[name] = ("with " + ",\n".join(named) + "\n" if named else "") + sql
        return f

    return register
