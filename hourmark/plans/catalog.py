"""Registry of runnable queries, each with its SQL statement where SQL can say it.

A query declares its output columns once (``name:kind``); both the Spark result
and the SQL statement are projected to them, so names, types and rounding agree.
Rounding happens only here, at the comparison boundary: engines add doubles in
different orders.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourmark.session import configure

Runner = Callable[[SparkSession, str], DataFrame]

#: Decimals kept at the comparison boundary.
DIGITS = 7


def _fixed_digits(c: Column) -> Column:
    """Round half up the same way in both engines: snap off noise, then floor."""
    value = c.cast("double")
    kept = F.floor(F.round(value, 10) * 10.0**DIGITS + 0.5) / 10.0**DIGITS
    return F.when(F.isnan(value), value).otherwise(kept)


SPARK_KINDS = {
    "s": lambda c: c.cast("string"),
    "i": lambda c: c.cast("bigint"),
    "f": _fixed_digits,
    "t": lambda c: c.cast("timestamp_ntz"),
    "d": lambda c: c.cast("date"),
}
SQL_KINDS = {
    "s": "CAST({c} AS VARCHAR)",
    "i": "CAST({c} AS BIGINT)",
    "f": f"floor(round(CAST({{c}} AS DOUBLE), 10) * 1e{DIGITS} + 0.5) / 1e{DIGITS}",
    "t": "CAST({c} AS TIMESTAMP)",
    "d": "CAST({c} AS DATE)",
}


@dataclass(frozen=True)
class Entry:
    name: str
    run: Runner
    spec: str
    body: str | None

    @property
    def sql(self) -> str | None:
        """The full statement; composed on use, when all named subqueries exist."""
        return statement(self.spec, self.body) if self.body else None


ENTRIES: dict[str, Entry] = {}
SQL_VIEWS: dict[str, str] = {}


def sql_view(name: str, body: str) -> None:
    """Name a reusable SQL subquery; statements that mention it get it as a CTE."""
    if name in SQL_VIEWS:
        raise ValueError(f"SQL subquery {name} is named twice")
    SQL_VIEWS[name] = body


def _views_for(body: str) -> list[str]:
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, sub in SQL_VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(sub)
                if name not in needed:
                    needed.append(name)

    visit(body)
    return needed


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.rsplit(":", 1)) for item in spec.split()]  # type: ignore[misc]


def statement(spec: str, body: str) -> str:
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in _views_for(body))
    cols = ", ".join(f"{SQL_KINDS[k].format(c=c)} AS {c}" for c, k in _columns(spec))
    return (f"WITH {ctes}\n" if ctes else "") + f"SELECT {cols} FROM ({body}) AS result"


def query(name: str, spec: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    """Register a query under ``name`` with its output columns and optional SQL."""

    def register(fn: Runner) -> Runner:
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, path: str) -> DataFrame:
            configure(spark)
            out = fn(spark, path)
            return out.select(*[SPARK_KINDS[k](F.col(c)).alias(c) for c, k in _columns(spec)])

        run.__doc__ = fn.__doc__
        ENTRIES[name] = Entry(name, run, spec, sql)
        return fn

    return register
