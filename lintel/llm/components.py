"""Connected components of large graphs, and the grouped streaming that operators on groups share.

``components`` contracts: every node hooks on to its smallest neighbour, links are restated between
the nodes hooked on to, and so on until no link is left, which at least halves the nodes that have
links each time. Partitions first reduce their links to a spanning forest. Once at most SMALL
links are left, a number that is counted each time, one task finishes them; it holds no more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.batches import checkpointed, map_arrow

SMALL = 500_000


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node each can reach)"""
    nodes, found = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = found[: len(a)], found[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, u, label[v])
        np.minimum.at(label, v, label[u])
        # hook roots too, else long chains take as many rounds as they have links
        np.minimum.at(label, before[u], label[v])
        np.minimum.at(label, before[v], label[u])
        label = label[label]
        if (label == before).all():
            return nodes, nodes[label]


def forest(links: DataFrame) -> DataFrame:
    """The same components with fewer links, each partition by itself; bounded parts at a time."""

    def make():
        def run(batches):
            a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for batch in batches:
                a = np.concatenate((a, batch.column("a").to_numpy()))
                b = np.concatenate((b, batch.column("b").to_numpy()))
                if len(a) > 2 * SMALL:
                    nodes, label = least_reachable(a, b)
                    a, b = nodes[nodes != label], label[nodes != label]
                    if len(a) > SMALL:
                        yield {"a": a, "b": b}
                        a, b = a[:0], b[:0]
            nodes, label = least_reachable(a, b)
            yield {"a": nodes[nodes != label], "b": label[nodes != label]}

        return run

    return map_arrow(links, make, "a bigint, b bigint")


def components(links: DataFrame, small: int = SMALL) -> DataFrame:
    """node, component of each node with a link to another one; links: columns a and b, nulls link nothing."""
    left = checkpointed(forest(links.filter("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))))
    maps = []
    while left.count() > small:
        both = left.union(left.select("b", "a"))
        hooks = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")))
        maps.append(hooks)
        ends = [hooks.select(F.col("a").alias(x), F.col("to").alias(f"{x}_to")) for x in "ab"]
        left = left.join(ends[0], "a").join(ends[1], "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        left = checkpointed(forest(left.filter("a <> b").distinct()))

    def make():
        def run(batches):
            parts = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
            if parts:
                nodes, label = least_reachable(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                yield {"node": nodes, "component": label}

        return run

    out = map_arrow(left.coalesce(1), make, "node bigint, component bigint")
    for hooks in maps[::-1]:
        last = out.select(F.col("node").alias("to"), "component")
        out = hooks.join(last, "to", "left").select(F.col("a").alias("node"), F.coalesce("component", "to").alias("component"))
    return out


def grouped(df: DataFrame, keys: list[str], order: list[str], make: Callable[[], Callable], schema: str, partitions: int | None = None) -> DataFrame:
    """df dealt by keys, sorted by keys and order, through make()(runs): runs yields (whole groups as one table).

    A group is held whole, so keys must bound it; small groups come many at a time.
    """
    parts = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return map_arrow(parts.sortWithinPartitions(*keys, *order), lambda: whole_groups(keys, make()), schema)


def whole_groups(keys: list[str], fn: Callable, limit: int = 4 << 20) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]):
        def tables():
            held: list[pa.Table] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                held.append(pa.Table.from_batches([batch]))
                if sum(t.nbytes for t in held) < limit:
                    continue
                table = pa.concat_tables(held).combine_chunks()
                cut = starts(table, keys)[-1]
                if cut:
                    yield table.slice(0, cut)
                held = [table.slice(cut)]
            if held:
                yield pa.concat_tables(held).combine_chunks()

        return fn(tables())

    return run


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First rows of a sorted table's groups; keys are numbers without nulls."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for key in keys:
        values = table.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)
