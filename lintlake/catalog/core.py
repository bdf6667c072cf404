"""The query catalogue: named Spark queries, the SQL each is checked with, and shared relations."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RELATIONS: dict[str, str] = {}


class Tables:
    """The given parquet tables of one scale folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(key: str, sql: str | None = None):
    """Register ``fn(tables)`` as query ``key``; ``sql`` may use ``{{relation}}`` names as tables."""

    def register(fn):
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[key] = with_relations(sql)
        return fn

    return register


def relation(name: str, sql: str) -> None:
    """A named SQL relation that checking queries may build on."""
    RELATIONS[name] = sql


def with_relations(sql: str) -> str:
    """Prefix ``sql`` with the relations it mentions as ``{{name}}``, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\{\{(\w+)\}\}", text):
            if name not in order:
                visit(RELATIONS[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    plain = lambda text: re.sub(r"\{\{(\w+)\}\}", r"\1", text)
    body = plain(sql).strip()
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS (\n{plain(RELATIONS[n]).strip()}\n)" for n in order)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def sql_case(column: str, mapping: dict, default: str = "NULL") -> str:
    show = lambda v: sql_text(v) if isinstance(v, str) else str(v)
    arms = " ".join(f"WHEN {show(k)} THEN {show(v)}" for k, v in mapping.items())
    return f"CASE {column} {arms} ELSE {default} END"


def sql_list(values) -> str:
    return ", ".join(sql_text(v) if isinstance(v, str) else str(v) for v in values)
