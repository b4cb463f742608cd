"""The catalog's window functions over expressions: one value a row, from the rows of its partition in order.

Spark sorts each partition in one task and reads it as a stream, so a partition may be larger than
memory, but one key's rows stay in one task; ranks alone, filtered to the first few, are cut ahead of the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.engine import Engine
from lintel.plans.typecheck import TypeCheckError

#: By id: (value over the window, whether it takes an expression).
FUNCTIONS: dict[str, tuple[Callable[[Column | None, int], Column], bool]] = {
    "row_number": (lambda c, n: F.row_number(), False),
    "rank": (lambda c, n: F.rank(), False),
    "dense_rank": (lambda c, n: F.dense_rank(), False),
    "percent_rank": (lambda c, n: F.percent_rank(), False),
    "cume_dist": (lambda c, n: F.cume_dist(), False),
    "ntile": (lambda c, n: F.ntile(n), False),
    "lead": (lambda c, n: F.lead(c, n), True),
    "lag": (lambda c, n: F.lag(c, n), True),
}
WHOLE = ("row_number", "rank", "dense_rank", "ntile")


class Over:
    """A window function by id. n: how many parts, or how many rows on or back."""

    def __init__(self, id: str, expr: str | None = None, n: int = 1):
        if id not in FUNCTIONS:
            raise TypeCheckError(f"no window function {id}; there are {', '.join(FUNCTIONS)}")
        if FUNCTIONS[id][1] != (expr is not None):
            raise TypeCheckError(f"{id} {'needs' if expr is None else 'takes no'} expression")
        if n < 1:
            raise TypeCheckError(f"{id} counts from 1")
        self.id, self.expr, self.n = id, expr, n


def over(engine: Engine, df: DataFrame, partition: list[str], order: list[str], **functions: Over) -> DataFrame:
    """df and a column for each function. partition, order: expressions; a minus ahead of a whole order turns it round, nulls come first or, turned, last."""
    if not order:
        raise TypeCheckError("window functions are ordered by something")
    keys = [engine.column(df, e) for e in partition]
    by = [engine.column(df, e[1:]).desc() if e.startswith("-") else engine.column(df, e).asc() for e in order]
    window = Window.partitionBy(*keys).orderBy(*by)
    columns = {}
    for name, own in functions.items():
        c = FUNCTIONS[own.id][0](engine.column(df, own.expr) if own.expr else None, own.n).over(window)
        columns[name] = c.cast("long") if own.id in WHOLE else c
    return df.select("*", *(c.alias(n) for n, c in columns.items()))
