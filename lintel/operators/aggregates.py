"""The catalog's aggregates over expressions, as Spark's own: partial before the shuffle, final after it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.engine import Engine
from lintel.functions.lower import column
from lintel.plans.typecheck import TypeCheckError
from lintel.types import NUMERIC, to_spark


class Aggregate:
    """id over an expression. by: an expression that orders rows, for first, last and nth_value; at: a percentile's share, a place, or what parts strings; other: the second expression of a correlation."""

    def __init__(self, id: str, expr: str | None = None, by: str | None = None, at: float | int | str | None = None, approximate: float | None = None, population: bool = False, other: str | None = None):
        if id not in AGGREGATES and id != "nth_value":
            raise TypeCheckError(f"no aggregate {id}; there are {', '.join(AGGREGATES)} and nth_value")
        if (expr is None) != (id == "count" and expr is None):
            raise TypeCheckError(f"{id} takes an expression")
        if (id in ORDERED) != (by is not None):
            raise TypeCheckError(f"{id} is {'ordered by' if id in ORDERED else 'not ordered by'} an expression")
        if (id in ("percentile", "nth_value", "string_agg")) != (at is not None):
            raise TypeCheckError(f"{id} {'needs' if at is None else 'takes no'} at")
        if (id == "corr") != (other is not None):
            raise TypeCheckError(f"{id} {'needs' if other is None else 'takes no'} other expression")
        self.id, self.expr, self.by, self.at, self.approximate, self.population, self.other = id, expr, by, at, approximate, population, other

    def column(self, engine: Engine, df: DataFrame) -> Column:
        if self.expr is None:
            return F.count(F.lit(1))
        if self.id == "nth_value":
            raise TypeCheckError("nth_value is not for windows of streams")
        typed = engine.typed(df, self.expr)
        if self.id in NUMERIC_ONLY and typed.type.kind not in NUMERIC:
            raise TypeCheckError(f"{self.id} takes numbers, not {typed.type}")
        c = column(typed, engine.registry.functions)
        by = engine.column(df, self.by) if self.by else None
        if self.other:
            return F.corr(c, engine.column(df, self.other))
        out = AGGREGATES[self.id](c, by, self)
        return out.cast(to_spark(typed.type)) if self.id in ("min", "max") else out


def percentile(c: Column, by: Column | None, own: Aggregate) -> Column:
    return F.percentile(c, F.lit(own.at)) if own.approximate is None else F.percentile_approx(c, own.at, int(1 / own.approximate))


AGGREGATES: dict[str, Callable[[Column, Column | None, Aggregate], Column]] = {
    "count": lambda c, by, own: F.count(c),
    "sum": lambda c, by, own: F.sum(c),
    "avg": lambda c, by, own: F.avg(c),
    "min": lambda c, by, own: F.min(c),
    "max": lambda c, by, own: F.max(c),
    "median": lambda c, by, own: F.median(c),
    "percentile": percentile,
    "count_distinct": lambda c, by, own: F.count_distinct(c) if own.approximate is None else F.approx_count_distinct(c, own.approximate),
    "first": lambda c, by, own: F.min_by(c, by),
    "last": lambda c, by, own: F.max_by(c, by),
    "std_dev": lambda c, by, own: F.stddev_pop(c) if own.population else F.stddev_samp(c),
    "variance": lambda c, by, own: F.var_pop(c) if own.population else F.var_samp(c),
    "product": lambda c, by, own: F.product(c),
    "bool_and_agg": lambda c, by, own: F.bool_and(c),
    "bool_or_agg": lambda c, by, own: F.bool_or(c),
    "string_agg": lambda c, by, own: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(by.alias("k"), c.alias("v"))))), lambda x: x.getField("v")), own.at),
    "sum0": lambda c, by, own: F.coalesce(F.sum(c), F.lit(0)),
    "corr": lambda c, by, own: c,
    "mode": lambda c, by, own: F.mode(c, True),
    "any_value": lambda c, by, own: F.any_value(c, True),
}
NUMERIC_ONLY = ("sum", "avg", "median", "percentile", "std_dev", "variance", "product", "sum0", "corr")
ORDERED = ("first", "last", "nth_value", "string_agg")


def nth_rows(engine: Engine, df: DataFrame, by: dict[str, str], name: str, own: Aggregate) -> DataFrame:
    """Keys, and the value in place own.at, from 1, of each group. Tasks pass on own.at rows of a group at most."""
    keys = [engine.column(df, e).alias(f"_key_{n}") for n, e in by.items()]
    place = F.row_number().over(Window.partitionBy(*(f"_key_{n}" for n in by)).orderBy("_by"))
    rows = df.select(*keys, engine.column(df, own.by).alias("_by"), engine.column(df, own.expr).alias(name))
    return rows.withColumn("_place", place).filter(F.col("_place") == own.at).drop("_by", "_place")


def aggregate(engine: Engine, df: DataFrame, by: dict[str, str] | None = None, **aggregates: Aggregate) -> DataFrame:
    """One row for each combination of the by expressions, or one for all rows."""
    by = by or {}
    placed = {n: a for n, a in aggregates.items() if a.id == "nth_value"}
    plain = {n: a.column(engine, df).alias(n) for n, a in aggregates.items() if n not in placed}
    keys = [engine.column(df, e).alias(n) for n, e in by.items()]
    out = df.groupBy(*keys).agg(*plain.values()) if plain else df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    for name, own in placed.items():
        rows = nth_rows(engine, df, by, name, own)
        condition = F.lit(True)
        for n in by:
            condition = condition & out[n].eqNullSafe(rows[f"_key_{n}"])
        out = out.join(rows, condition, "left").drop(*(f"_key_{n}" for n in by))
    return out.select(*by, *aggregates)
