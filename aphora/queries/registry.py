"""Named queries over the supplied tables, each with its statement in SQL where there is one."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aphora.sources.model import ORACLE_CTES, Model

AS_OF = "2024-01-31 00:00:00"
LAST_DAY = "2024-01-30"
SEED = 42


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Model], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}
# Intermediate tables that several statements share; they may name the model's tables and each other.
SHARED_CTES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may name the tables of the model."""
    def register(fn: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql)
        return fn

    return register


def full_sql(sql: str) -> str:
    """The statement with the definitions of all tables it names, directly or through another definition."""
    known = {**ORACLE_CTES, **SHARED_CTES}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"(?:FROM|JOIN)\s+([a-z_]+)", text):
            if word in known and word not in ordered:
                visit(known[word])
                if word not in ordered:
                    ordered.append(word)

    visit(sql)
    if not ordered:
        return sql.strip()
    if sql.strip().upper().startswith("WITH"):
        sql = f"SELECT * FROM ({sql.strip()}) statement"
    definitions = ",\n".join(f"{name} AS ({known[name].strip()})" for name in ordered)
    return f"WITH {definitions}\n{sql.strip()}"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def last_day() -> Column:
    return F.lit(LAST_DAY).cast("date")


def joined(items: str | Column, separator: str = ",") -> Column:
    """A list as text: results are compared as plain columns."""
    return F.array_join(F.col(items) if isinstance(items, str) else items, separator)
