"""Registry of queries: one DataFrame plan and, where SQL can say it, one DuckDB text.

The output columns of a query are declared once (``name:type``) and applied to both
sides, so names, types and rounding cannot drift. Types: s text, i bigint, b boolean,
d date as text, t instant as text, f double (``f6`` rounds to six places).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knownwhen.plans.views import SQL_VIEWS, Tables
from knownwhen.session import configure


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        df = self.build(Tables(spark, sf_dir))
        return df.select(*[_spark_cast(n, t) for n, t in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = ", ".join(_duck_cast(n, t) for n, t in self.columns)
        return with_views(f"select {cols} from (\n{self.sql.strip()}\n) as answer")


CATALOG: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Register the decorated builder under ``name``."""
    cols = tuple((x.split(":")[0], x.split(":")[1]) for x in columns.split())

    def add(fn: Callable[[Tables], DataFrame]):
        assert name not in CATALOG, name
        CATALOG[name] = Query(name, cols, fn, sql)
        return fn

    return add


def with_views(sql: str) -> str:
    """Put the derived views a text names in front of it as common table expressions."""
    need: list[str] = []
    open_: set[str] = set()

    def visit(text: str) -> None:
        for name, body in SQL_VIEWS.items():
            # A recursive view names itself.
            if name not in need and name not in open_ and re.search(rf"\b{name}\b", text):
                open_.add(name)
                visit(body)
                need.append(name)

    visit(sql)
    if not need:
        return sql
    head = ",\n".join(f"{n} as ({SQL_VIEWS[n].strip()})" for n in need)
    return f"with recursive {head}\n{sql}"


def _spark_cast(name: str, kind: str) -> Column:
    x = F.col(name)
    if kind[0] == "f":
        x = x.cast("double")
        return ((F.round(x, int(kind[1:])) if kind[1:] else x) + F.lit(0.0)).alias(name)
    if kind == "t":
        return F.date_format(x.cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)
    if kind == "d":
        return x.cast("date").cast("string").alias(name)
    return x.cast({"s": "string", "i": "bigint", "b": "boolean"}[kind]).alias(name)


def _duck_cast(name: str, kind: str) -> str:
    if kind[0] == "f":
        x = f"cast({name} as double)"
        return f"({f'round({x}, {kind[1:]})' if kind[1:] else x} + 0.0) as {name}"
    if kind == "t":
        return f"strftime(cast({name} as timestamp), '%Y-%m-%d %H:%M:%S.%f') as {name}"
    if kind == "d":
        return f"strftime(cast({name} as date), '%Y-%m-%d') as {name}"
    return f"cast({name} as {dict(s='varchar', i='bigint', b='boolean')[kind]}) as {name}"
