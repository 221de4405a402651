"""Registry of runnable queries, each with an optional oracle in plain SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.plans.tables import CTES, Tables
from corpusmill.session import configure

_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


@dataclass(frozen=True)
class Query:
    name: str
    columns: dict[str, str]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Tables(configure(spark), sf_dir))
        return df.select(*[F.col(c).cast(t).alias(c) for c, t in self.columns.items()])

    def oracle(self) -> str | None:
        """One SQL statement; derived inputs come in as common table expressions."""
        if self.sql is None:
            return None
        wanted, queue = [], [self.sql]
        while queue:
            text = queue.pop()
            for name, body in CTES.items():
                if "{" + name + "}" in text and name not in wanted:
                    wanted.append(name)
                    queue.append(body)
        ordered = [n for n in CTES if n in wanted]
        parts = [f"{n} AS (\n{CTES[n]}\n)" for n in ordered] + [f"_result AS (\n{self.sql}\n)"]
        casts = ", ".join(f"CAST({c} AS {_DUCK[t]}) AS {c}" for c, t in self.columns.items())
        text = ("WITH RECURSIVE " if {"anchors", "turn_states"} & set(wanted) else "WITH ") + ",\n".join(parts) + f"\nSELECT {casts} FROM _result"
        for name in CTES:
            text = text.replace("{" + name + "}", name)
        for name in Tables.BASE:
            text = text.replace("{" + name + "}", name)
        return text


REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Register ``build(tables) -> DataFrame`` under ``name``."""
    spec = dict(part.split() for part in columns.split(","))

    def register(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, spec, build, sql)
        return build

    return register
