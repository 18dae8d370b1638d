"""Named queries, each with the SQL another engine checks it by."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tallymark.sources.fixtures import VIEW_SQL, Tables


VIEW_NAME = re.compile(r"\b[ev]_\w+")


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    check: str | None = None
    views: dict[str, str] | None = None

    @property
    def sql(self) -> str | None:
        return with_views(self.check, self.views) if self.check else None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


REGISTRY: dict[str, Query] = {}


def with_views(sql: str, views: dict[str, str] | None = None) -> str:
    """Prefix the check SQL with the derived tables it names."""
    known = {**VIEW_SQL, **(views or {})}
    needed: list[str] = []

    def need(text: str) -> None:
        for name in dict.fromkeys(VIEW_NAME.findall(text)):
            if name in known and name not in needed:
                need(known[name])
                needed.append(name)

    need(sql)
    ctes = ", ".join(f"{name} AS ({known[name]})" for name in needed)
    if not ctes:
        return sql
    body = sql.lstrip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


def query(name: str, sql: str | None = None, views: dict[str, str] | None = None):
    """Register a plan under ``name``; ``sql`` is its check, or None where SQL cannot express it."""

    def wrap(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, build, sql, views)
        return build

    return wrap
