"""Query registry: a callable per operator and, beside it, the SQL that must agree with it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BODIES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def query(name: str, oracle: str | None = None, **instead: str):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with an optional SQL body and the views it redefines."""

    def wrap(fn):
        from thinmarket.plans.binding import Tables

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(Tables(spark, sf_dir)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if oracle is not None:
            BODIES[name] = oracle
            ORACLES[name] = full_sql(oracle, **instead)
        return fn

    return wrap


def plain(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text, so that every client compares them alike."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("string").alias(f.name)
            if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def earlier_views(names: list[str]) -> None:
    """Copies of views under their names with a 0, which refer to each other's copies."""
    pattern = re.compile(r"\b(" + "|".join(names) + r")\b(?!\.)")
    VIEWS.update({f"{name}0": pattern.sub(r"\g<1>0", VIEWS[name]) for name in names})


def full_sql(body: str, **instead: str) -> str:
    """Prefix the shared views that ``body`` mentions and expand the Rn() rounding shorthand.

    ``instead`` has other definitions of some views; all views that build on these see them.
    """
    needed: list[str] = []
    views = {**VIEWS, **instead}

    def visit(text: str, above: tuple[str, ...]) -> None:
        words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text))
        for name in views:
            if name in words and name not in needed and name not in above:
                visit(views[name], (*above, name))
                if name not in needed:
                    needed.append(name)

    visit(body, ())
    ctes = [f"{name} AS ({views[name]})" for name in needed]
    head = "WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else ""
    return expand_rounding(f"{head}SELECT * FROM (\n{body.strip()}\n)")


def expand_rounding(sql: str) -> str:
    """``R2(x)`` becomes the nudged ``round(x, 2)`` of ``numeric.rnd``."""
    while True:
        m = re.search(r"\bR(\d)\(", sql)
        if not m:
            return sql
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        inner = sql[m.end() : i - 1]
        sql = f"{sql[:m.start()]}(round(CAST(({inner}) AS DOUBLE) + 1e-9, {m.group(1)}) + 0.0){sql[i:]}"
