"""The front door: expressions in text over DataFrames, batch or streaming."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions.cel import Translation, parse
from lintel.functions.lower import column, enriched_name, nodes, with_urls
from lintel.functions.udf import Registry
from lintel.ir import Expr
from lintel.plans.passes import Import, reads, resolve, simplify
from lintel.plans.typecheck import CastMode, Checker, Enriched, Schema, Typed
from lintel.types import BOOL

#: Rows of a looked-up table up to which it is sent to all executors rather than shuffled; counted, never assumed.
BROADCAST_ROWS = 100_000


class Engine:
    """Expressions with one set of imports, lookups and casting rules.

    enrichments: tables to look up in, by name, as (table, key columns shared with the row).
    """

    def __init__(self, registry: Registry | None = None, imports: Iterable[Import] = (), enrichments: Mapping[str, tuple[DataFrame, list[str]]] | None = None, mode: CastMode = CastMode.SAFE):
        self.registry, self.imports, self.enrichments, self.mode = registry or Registry(), list(imports), dict(enrichments or {}), mode

    def translate(self, text: str) -> Translation:
        return parse(text, {i.visible for i in self.imports})

    def typed(self, df: DataFrame, expr: str | Expr) -> Typed:
        tree = self.translate(expr).expr if isinstance(expr, str) else expr
        tree = resolve(tree, self.imports, self.registry.arities)
        schema = Schema.of(df, {k: t for k, (t, _) in self.enrichments.items()})
        return simplify(Checker(schema, self.mode, self.registry.functions).check(tree))

    def reads(self, text: str):
        return reads(resolve(self.translate(text).expr, self.imports, self.registry.arities), self.registry.languages)

    def column(self, df: DataFrame, expr: str | Expr, on_error: str = "raise") -> Column:
        return column(self.typed(df, expr), self.registry.functions, on_error)

    def joined(self, df: DataFrame, typed: Iterable[Typed]) -> DataFrame:
        """df with the lookups that the expressions need, a left join for each table."""
        needed: dict[str, set[str]] = {}
        for t in typed:
            for node in nodes(t):
                if isinstance(node.node, Enriched):
                    needed.setdefault(node.node.table, set()).add(node.node.column)
        for table, columns in sorted(needed.items()):
            dim, keys = self.enrichments[table]
            side = dim.select(*keys, *(F.col(c).alias(enriched_name(table, c)) for c in sorted(columns))).dropDuplicates(keys)
            small = not dim.isStreaming and dim.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
            df = df.join(F.broadcast(side) if small else side, keys, "left")
        return df

    def filter(self, df: DataFrame, expr: str | Expr, on_error: str = "raise") -> DataFrame:
        """Rows for which the condition holds; on_error: raise, or false to leave out rows where it fails."""
        typed = self.typed(df, expr)
        if typed.type != BOOL:
            raise TypeError(f"a condition is bool, not {typed.type}")
        columns = df.columns
        return self.joined(df, [typed]).filter(column(typed, self.registry.functions, on_error)).select(*(f"`{c}`" for c in columns))

    def select(self, df: DataFrame, on_error: str = "raise", keep: Iterable[str] = (), **exprs: str | Expr) -> DataFrame:
        """Kept columns, and an expression under each name."""
        typed = {name: self.typed(df, e) for name, e in exprs.items()}
        df, urls = with_urls(self.joined(df, typed.values()), typed.values(), self.registry.functions)
        return df.select(*keep, *(column(t, self.registry.functions, on_error, urls).alias(n) for n, t in typed.items()))
