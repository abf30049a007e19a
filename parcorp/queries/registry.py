"""Registered queries: a Spark callable and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcorp.session import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; texts are spread over the cores when their files would leave them idle."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "conversations") else df


# ---- small helpers to write the SQL side ------------------------------------------------
def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_replace(expr: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        expr = f"replace({expr}, {q(a)}, {q(b)})"
    return expr


def sql_regex(expr: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(repl)}, 'g')"


def sql_rewrite(expr: str, pattern: str, merge: str, group: int = 0) -> str:
    """Fold `merge` (over acc and m) over the matches, starting from the text."""
    return (
        f"list_reduce(list_prepend({expr}, regexp_extract_all({expr}, {q(pattern)}, {group})), "
        f"lambda acc, m: {merge})"
    )


def sql_steps(start: str, steps: list[str], final: str) -> str:
    """WITH s0 AS (start), s1 AS (SELECT * REPLACE (step AS t) FROM s0), … final over {s}."""
    ctes = [f"s0 AS MATERIALIZED ({start})"]
    for i, step in enumerate(steps):
        ctes.append(f"s{i + 1} AS MATERIALIZED (SELECT * REPLACE ({step} AS t) FROM s{i})")
    return "WITH " + ",\n".join(ctes) + "\n" + final.format(s=f"s{len(steps)}")
