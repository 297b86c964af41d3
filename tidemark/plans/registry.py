"""Where queries and their oracles meet: one entry per operator, columns and rounding stated once for both sides."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .oracle_views import CTES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _columns(spec: str) -> list[tuple[str, int | None]]:
    out = []
    for part in spec.split():
        name, _, digits = part.partition("~")
        out.append((name, int(digits) if digits else None))
    return out


def nudge(digits: int) -> float:
    """An offset off half-way points, where sums in another order would round apart."""
    return float(f"3.14e-{digits + 3}")


def tidy(df: DataFrame, spec: str) -> DataFrame:
    """df's columns in spec order: name~n rounds to n places, integers widen to BIGINT, stamps lose their zone."""
    cols = []
    for name, digits in _columns(spec):
        kind, c = df.schema[name].dataType, F.col(name)
        if digits is not None:
            c = F.round(c.cast("double") + F.lit(nudge(digits)), digits) + F.lit(0.0)
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(kind, T.TimestampType):
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(name))
    return df.select(*cols)


def oracle(body: str, spec: str | None = None, ctes: dict[str, str] | None = None) -> str:
    """body with the common table expressions it names, in dependency order, and the spec's rounding."""
    need: list[str] = []
    seen: set[str] = set()
    known = {**CTES, **(ctes or {})}

    def visit(text):
        for name in known:
            if name not in seen and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                seen.add(name)
                visit(known[name])
                need.append(name)

    visit(body)
    if spec is not None:
        cols = ", ".join(f"round({n} + {nudge(d)!r}::DOUBLE, {d}) + 0.0::DOUBLE AS {n}" if d is not None else n for n, d in _columns(spec))
        body = f"SELECT {cols} FROM ({body})"
    if need:
        # RECURSIVE allows a body that names itself and changes nothing for the others.
        body = "WITH RECURSIVE " + ",\n".join(f"{n} AS ({known[n]})" for n in need) + "\n" + body
    # AT is a reserved word in DuckDB.
    return re.sub(r"\bat\b", '"at"', body)


def query(name: str, spec: str, sql: str | None = None, ctes: dict[str, str] | None = None) -> Callable[[Query], Query]:
    """Registers fn under name; spec lists result columns, sql is the oracle's select over CTES and ctes."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir), spec)
        if sql is not None:
            ORACLES[name] = oracle(sql, spec, ctes)
        return fn
    return add
