"""Registered queries: a name, the Spark callable, the oracle SQL and the survey items it covers."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from curatrix.plans.frames import BASE_TABLES, FRAMES

SLOT = re.compile(r"\{([a-z]\w*)\}")


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[["Data"], DataFrame]
    covers: tuple[str, ...]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(data) -> DataFrame``; ``{frame}`` slots in ``sql`` name base tables or derived frames."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, tuple(covers.split()), sql)
        return fn

    return add


class Data:
    """The given tables, plus governance frames that Spark SQL derives from them, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._seen: dict[str, DataFrame] = {}

    def path(self, table: str) -> str:
        return f"{self.sf_dir}/{table}.parquet"

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._seen:
            if name in BASE_TABLES:
                df = self.spark.read.parquet(self.path(name))
            else:
                df = self.sql(FRAMES[name])
            self._seen[name] = df
        return self._seen[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: self[n] for n in set(SLOT.findall(text))})


def oracle_text(sql: str) -> str:
    """The oracle statement with every derived frame it names spelled out as a CTE."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in dict.fromkeys(SLOT.findall(text)):
            if name in BASE_TABLES or name in order:
                continue
            need(FRAMES[name])
            order.append(name)

    need(sql)
    ctes = ", ".join(f"{n} AS ({FRAMES[n].strip()})" for n in order)
    body = sql.strip()
    if ctes:
        head = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
        if head:
            body = f"WITH {head.group(1) or ''}{ctes}, {body[head.end():]}"
        else:
            body = f"WITH {ctes} {body}"
    return SLOT.sub(r"\1", body)
