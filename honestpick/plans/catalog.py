"""Registry of the queries: name -> (Spark function, equivalent SQL or None)."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in CATALOG:
            raise ValueError(f"query {name} registered twice")
        CATALOG[name] = Query(fn, sql)
        return fn
    return add


def r(c, digits: int = 6) -> Column:
    """Rounded double, as compared with SQL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


def load_all() -> dict[str, Query]:
    from importlib import import_module
    for part in ("arms", "effects", "sources", "bootstrap", "splits", "shrink", "selective", "regress",
                 "report", "targeting", "assortment"):
        import_module(f"honestpick.plans.queries_{part}")
    return CATALOG
