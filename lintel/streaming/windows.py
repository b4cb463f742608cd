"""Expressions over streams: what the clock in them asks of the trigger, windows, and lookups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lintel.engine import Engine
from lintel.operators.aggregates import Aggregate


def bucket(time: Column | str, interval_ms: int, offset_ms: int = 0) -> Column:
    """The start of the interval that a time lies in; intervals are counted from the offset."""
    return F.window(time, f"{interval_ms} milliseconds", f"{interval_ms} milliseconds", f"{offset_ms % interval_ms} milliseconds").getField("start")


def trigger_ms(engine: Engine, exprs: Iterable[str], least: int = 1000) -> int | None:
    """How often results may change by the clock alone: the finest granularity read, or None for never."""
    finest = [f for e in exprs if (f := engine.reads(e).finest())]
    return max(min(f[0] for f in finest), least) if finest else None


def triggered(writer: DataStreamWriter, engine: Engine, exprs: Iterable[str]) -> DataStreamWriter:
    """writer with a trigger as often as the expressions' clock needs; as data comes if they read none."""
    every = trigger_ms(engine, exprs)
    return writer.trigger(processingTime=f"{every} milliseconds") if every else writer


def windowed(engine: Engine, df: DataFrame, time: str, size: str, aggregates: dict[str, Aggregate], by: dict[str, str] | None = None, slide: str | None = None, offset: str | None = None, late: str | None = None, gap: bool = False) -> DataFrame:
    """Aggregates of tumbling windows, sliding ones with slide, or sessions with gap (size is the gap).

    late: how long after a window's end its rows may still come. With it, append mode gives complete
    windows only; in update mode a window's row is a part result until then.
    """
    if late:
        df = df.withWatermark(time, late)
    frame = F.session_window(time, size) if gap else F.window(time, size, slide, offset)
    keys = [engine.column(df, e).alias(n) for n, e in (by or {}).items()]
    out = df.groupBy(frame.alias("_window"), *keys).agg(*(a.column(engine, df).alias(n) for n, a in aggregates.items()))
    return out.select(F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), *(by or {}), *aggregates)


def joined_streams(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, within: str, late: str, how: str = "inner") -> DataFrame:
    """Rows of two streams with equal keys at most an interval apart; watermarks bound what waits."""
    a, b = left.withWatermark(left_time, late).alias("a"), right.withWatermark(right_time, late).alias("b")
    near = F.expr(f"b.`{right_time}` between a.`{left_time}` - interval {within} and a.`{left_time}` + interval {within}")
    condition = near
    for k in keys:
        condition = condition & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    rest = [F.col(f"b.`{c}`") for c in right.columns if c not in keys and c not in left.columns]
    return a.join(b, condition, how).select(*(F.col(f"a.`{c}`") for c in left.columns), *rest)
