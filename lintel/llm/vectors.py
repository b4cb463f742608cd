"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Vectors are compared only within one label and one dimension. Equal vectors of a label are one
node. Each label's nodes get cells: centroids of spherical k-means, one for about CELL nodes or for
more where all centroids would exceed CENTROID_BYTES, fitted on about SAMPLE vectors a label, a
documented bound; every vector is then assigned to its nearest centroid. So that no link across a border is lost, a vector also visits each cell whose
border with its own it could reach: two vectors of cosine at least t lie within the angle
acos(t), so the visit is needed only if the vector lies within that angle of the plane between the
two centroids. Both ends of a link would visit, so only those go whose cell comes before. Cells are cut into blocks by hash,
of residents and of visitors, of up to BLOCK vectors and BLOCK_BYTES; a task multiplies two of them, each two once, in single
precision, and what could reach the threshold in double precision. Blocks report how many links each vector has, and a
spanning forest of the links, never all pairs. Products, and the copies of visiting vectors, are made
in steps of STEP_BYTES, however many cells there are.

Vectors of floats are kept as such, and a block is copied for each one that it meets. So that the copies of a table
without cluster structure, where all blocks of a label meet, take no more disk than the vectors themselves, the
pairs of blocks are dealt into rounds, and a round's shuffle is dropped before the next.

Vectors that are null, zero, or hold a null or non-finite component, and vectors with a null
label, link with nothing. Rows that share an id are one node of the graph but have their own
counts. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.batches import checkpointed, map_arrow, released, written
from lintel.llm.components import components, grouped, least_reachable, starts

THRESHOLD, CELL, SAMPLE, ROUNDS, BLOCK, SEED = 0.93, 4096, 20_000, 8, 16_384, 5
#: Of a block's vectors, and of all copies that are shuffled at once unless the vectors themselves are more.
BLOCK_BYTES, SHUFFLE_BYTES = 8 << 20, 64 << 20
#: Of all centroids together, which go to every task; a group that is larger than a cell has rounding on top.
CENTROID_BYTES = 32 << 20
#: Of products with centroids, and of copies of vectors, that a task holds at once.
STEP_BYTES = 32 << 20
#: Against rounding, when deciding whom to visit; links themselves are decided by the threshold alone.
MARGIN = 1e-6


def kind_of(vectors: DataFrame, vector: str) -> str:
    """The numbers that hold a vector's components exactly: floats as such, all others as doubles."""
    return "f4" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "f8"


def as_bytes(vectors: DataFrame, vector: str, key: str, label: str) -> DataFrame:
    """key, grp (label and dimension), dim, data (of kind_of), print; grp and data are null where nothing can link."""
    kind = kind_of(vectors, vector)

    def make():
        def run(batches):
            for batch in batches:
                lists = batch.column(vector)
                values = lists.values.cast(pa.float32() if kind == "f4" else pa.float64())
                flat = pc.fill_null(values, np.nan).to_numpy(zero_copy_only=False)
                at = lists.offsets.to_numpy()
                labels, out = batch.column(label).to_pylist(), {"grp": [], "dim": [], "data": [], "print": []}
                for i, there in enumerate(lists.is_valid().to_pylist()):
                    own = flat[at[i] : at[i + 1]] + flat.dtype.type(0)  # no negative zeros
                    good = there and labels[i] is not None and len(own) > 0 and np.isfinite(own).all() and own.any()
                    data = own.tobytes() if good else None
                    out["grp"].append(f"{labels[i]}/{len(own)}" if good else None)
                    out["dim"].append(len(own))
                    out["data"].append(data)
                    out["print"].append(hashlib.blake2b(out["grp"][-1].encode() + b"/" + data, digest_size=16).digest() if good else None)
                yield {"key": batch.column(key)} | out

        return run

    return map_arrow(vectors.select(key, label, vector), make, "key bigint, grp string, dim int, data binary, print binary")


def unit(data: list[bytes], kind: str = "f8") -> np.ndarray:
    x = np.frombuffer(b"".join(data), kind).astype(np.float64).reshape(len(data), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def products(x: np.ndarray, c: np.ndarray, limit: int) -> Iterator[tuple[int, np.ndarray]]:
    """x @ c.T in steps of rows of at most limit bytes, each with its first row's place."""
    step = max(1, limit // (8 * len(c)))
    for low in range(0, len(x), step):
        yield low, x[low : low + step] @ c.T


def centroids(x: np.ndarray, n: int, limit: int) -> np.ndarray:
    """Spherical k-means from seeded starts; empty cells are dropped."""
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = np.concatenate([near.argmax(1) for _, near in products(x, c, limit)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1)
        c = total[size > 1e-9] / size[size > 1e-9][:, None]
    return c


def fitted(nodes: DataFrame, kind: str) -> dict[str, np.ndarray]:
    """Centroids by group, where it is larger than a cell; each group's are fitted in one task on its sample."""
    whole = nodes.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    # cells grow so that all centroids together stay within their bound
    limit, cell = STEP_BYTES, max(CELL, -(-whole["n"] * 8 * (whole["dim"] or 0) // CENTROID_BYTES))
    sizes = nodes.groupBy("grp").agg(F.count("*").alias("size")).filter(F.col("size") > cell)
    # a hash decides, so the sample is the same whenever a task runs again
    drawn = F.pmod(F.xxhash64("print"), F.lit(1 << 30)) < F.lit(SAMPLE) / F.col("size") * (1 << 30)
    sample = nodes.select("grp", "print", "data").join(F.broadcast(sizes), "grp").filter(drawn)

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("print")
        found = centroids(unit(own["data"].tolist(), kind), -(-int(own["size"].iloc[0]) // cell), limit)
        return pd.DataFrame({"grp": own["grp"].iloc[0], "centroids": [found.tobytes()], "cells": [len(found)]})

    rows = sample.groupBy("grp").applyInPandas(fit, "grp string, centroids binary, cells int").collect()
    return {r["grp"]: np.frombuffer(bytes(r["centroids"])).reshape(r["cells"], -1) for r in rows}


def assigned(nodes: DataFrame, cells: dict[str, np.ndarray], threshold: float, kind: str) -> DataFrame:
    """grp, cell, home, node, copies, data: each node in its own cell and in those after it that it has to visit."""
    shared = nodes.sparkSession.sparkContext.broadcast(cells)
    reach = np.sqrt(1 - threshold**2) + MARGIN if threshold > 0 else 2.0
    limit = STEP_BYTES

    def placed(batch, at, cell, home):
        return {n: batch.column(n).take(pa.array(at)) for n in ("grp", "node", "copies", "data")} | {"cell": cell, "home": home}

    def make():
        def run(batches):
            for batch in batches:
                groups = np.array(batch.column("grp").to_pylist())
                alone = np.array([len(shared.value.get(grp, ())) < 2 for grp in groups], bool)
                if alone.any():
                    at = np.flatnonzero(alone)
                    yield placed(batch, at, np.zeros(len(at), np.int64), np.ones(len(at), bool))
                for grp in np.unique(groups[~alone]):
                    own, c = np.flatnonzero(groups == grp), shared.value[grp]
                    x, rows = unit(batch.column("data").take(pa.array(own)).to_pylist(), kind), max(1, limit // c[0].nbytes)
                    for low, near in products(x, c, limit):
                        best = near.argmax(1)
                        gap = np.sqrt(np.maximum(2 - 2 * c[best] @ c.T, 1e-18))
                        visit = near.max(1)[:, None] - near <= reach * gap
                        visit &= np.arange(len(c)) > best[:, None]
                        visit[np.arange(len(near)), best] = True
                        i, k = np.nonzero(visit)
                        for first in range(0, len(i), rows):
                            a, b = i[first : first + rows], k[first : first + rows]
                            yield placed(batch, own[low + a], b, best[a] == b)

        return run

    return map_arrow(nodes.select("grp", "node", "copies", "data"), make, "grp string, cell int, home boolean, node bigint, copies bigint, data binary")


def hits(x: np.ndarray, y: np.ndarray, same: bool, threshold: float, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in x and y of pairs whose cosine reaches threshold, in steps; same: x is y, and each two meet once."""
    x4, y4 = x.astype(np.float32), y.astype(np.float32)
    # what single precision may lack; from there on doubles decide
    least = threshold - (x.shape[1] + 8) * 2.0**-22
    step = max(1, limit // (32 * len(y)))
    for low in range(0, len(x), step):
        begin = low if same else 0
        u, v = np.nonzero(x4[low : low + step] @ y4[begin:].T >= least)
        if 16 * len(u) > min(step, len(x) - low) * (len(y) - begin):
            u, v = np.nonzero(x[low : low + step] @ y[begin:].T >= threshold)
        elif len(u):
            part = max(1, limit // (16 * x.shape[1]))
            good = np.concatenate([np.einsum("ij,ij->i", x[low + u[a : a + part]], y[begin + v[a : a + part]]) >= threshold for a in range(0, len(u), part)])
            u, v = u[good], v[good]
        u, v = u + low, v + begin
        if same:
            u, v = u[u < v], v[u < v]
        if len(u):
            yield u, v


def joined_up(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """label, which has a place of each row's component, after the rows u are joined with v; u ascends."""
    first = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
    # once each row is joined with one, most others are with it
    for pick in (first, slice(None)):
        a, b = label[u[pick]], label[v[pick]]
        if (a != b).any():
            node, to = least_reachable(a[a != b], b[a != b])
            least = np.arange(len(label))
            least[node] = to
            label = least[label]
    return label


def blocked(placed: DataFrame) -> tuple[DataFrame, int, int]:
    """(grp, cell, residents, visitors: how many blocks of each there are, unless 1 and 0; bytes of all residents; bytes of all copies)"""
    n, size = F.count("*"), F.sum(F.length("data"))
    sides = placed.groupBy("grp", "cell", "home").agg(F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).alias("blocks"), size.alias("bytes"))
    own, others = F.col("home"), ~F.col("home")
    both = sides.groupBy("grp", "cell").agg(*(F.coalesce(F.sum(F.when(side, F.col(c))), F.lit(0)).cast("long").alias(f"{name}{c}") for side, name in ((own, "own_"), (others, "other_")) for c in ("blocks", "bytes")))
    both = checkpointed(both)
    copies = F.col("own_bytes") * (F.col("own_blocks") + F.col("other_blocks")) + F.col("other_bytes") * F.col("own_blocks")
    sums = both.agg(F.sum("own_bytes").alias("own"), F.sum(copies.cast("double")).alias("copies")).first()
    # no more cells than there are centroids and full blocks
    blocks = both.filter("own_blocks > 1 or other_blocks > 0").select("grp", "cell", F.col("own_blocks").alias("residents"), F.col("other_blocks").alias("visitors"))
    return blocks, int(sums["own"] or 0), int(sums["copies"] or 0)


def tiled(placed: DataFrame, blocks: DataFrame, turn: int, turns: int) -> DataFrame:
    """tile, tile2, side, node, copies, data of the pairs of blocks that meet in a round; side 2: a block meets itself."""
    each = placed.join(F.broadcast(blocks), ["grp", "cell"], "left").fillna({"residents": 1, "visitors": 0})
    each = each.withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.when(F.col("home"), F.col("residents")).otherwise(F.col("visitors"))))
    first = F.pmod(F.lit(turn) - F.col("own") - F.pmod(F.xxhash64("grp", "cell"), F.lit(turns)), F.lit(turns))

    def met(many: str, entry):
        """entry of each block whose number and this one's add up to the round's."""
        there = F.sequence(first, F.col(many) - 1, F.lit(turns).cast("long"))
        return F.when(first < F.col(many), F.transform(there, entry)).otherwise(F.array().cast("array<struct<visit:boolean,i:bigint,j:bigint,side:int>>"))

    def entry(visit: bool, i, j, side):
        return F.struct(F.lit(visit).alias("visit"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))

    own = F.col("own")
    residents = met("residents", lambda k: entry(False, F.least(own, k), F.greatest(own, k), F.when(own == k, 2).otherwise((own > k).cast("int"))))
    hosts, guests = met("visitors", lambda k: entry(True, k, own, F.lit(1))), met("residents", lambda k: entry(True, own, k, F.lit(0)))
    each = each.select("*", F.explode(F.when(F.col("home"), F.concat(residents, hosts)).otherwise(guests)).alias("t"))
    name = ["grp", "cell", "t.visit", "t.i", "t.j"]
    return each.select(F.xxhash64(*name).alias("tile"), F.xxhash64(F.lit(7), *name).alias("tile2"), "t.side", "node", "copies", "data")


def multiplied(nodes: DataFrame, cells: dict[str, np.ndarray], threshold: float, kind: str) -> DataFrame:
    """node, n: how many vectors a node's are linked with; and where to is not null, node and to are linked."""
    limit, placed = STEP_BYTES, assigned(nodes, cells, threshold, kind)
    blocks, whole, copies = blocked(placed)
    turns = max(1, -(-copies // max(SHUFFLE_BYTES, whole)))
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), copies // turns // (4 * BLOCK_BYTES))

    def make():
        def run(tables):
            for table in tables:
                begin = [*starts(table, ["tile", "tile2"]), table.num_rows]
                for a, b in zip(begin[:-1], begin[1:], strict=True):
                    part = table.slice(a, b - a)
                    side = part.column("side").to_numpy()
                    same = side[0] == 2
                    rows, others = (np.arange(len(side)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
                    if not len(rows) or not len(others):
                        continue
                    x, nodes, copies = unit(part.column("data").to_pylist(), kind), part.column("node").to_numpy(), part.column("copies").to_numpy()
                    n, label = np.zeros(len(side), np.int64), np.arange(len(side))
                    for u, v in hits(x if same else x[rows], x if same else x[others], same, threshold, limit):
                        u, v = rows[u], others[v]
                        apart = nodes[u] != nodes[v]
                        u, v = u[apart], v[apart]
                        if len(u):
                            n += np.bincount(u, copies[v], len(n)).astype(np.int64) + np.bincount(v, copies[u], len(n)).astype(np.int64)
                            label = joined_up(label, u, v)
                    links, found = np.flatnonzero(label != np.arange(len(label))), n > 0
                    yield {
                        "node": np.concatenate((nodes[found], nodes[links])),
                        "n": np.concatenate((n[found], np.zeros(len(links), np.int64))),
                        "to": pa.array(np.concatenate((n[found] * 0, nodes[label[links]])), mask=np.concatenate((np.ones(found.sum(), bool), np.zeros(len(links), bool)))),
                    }

        return run

    def round_(turn: int) -> DataFrame:
        tiles = tiled(placed, blocks, turn, turns)
        return checkpointed(grouped(tiles, ["tile", "tile2"], ["side", "node"], make, "node bigint, n bigint, to bigint", parts))

    return reduce(DataFrame.union, [round_(turn) for turn in range(turns)])


def deduplicated(vectors: DataFrame, threshold: float = THRESHOLD, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """key, n_links, component_id, kept of every row."""
    kind = kind_of(vectors, vector)
    rows = as_bytes(vectors.select(F.col(key).cast("long").alias(key), F.col(label).cast("string").alias(label), vector), vector, key, label)
    usable = rows.filter("print is not null and key is not null")
    first = [F.first(c).alias(c) for c in ("grp", "dim", "data")]
    nodes = released(written(usable.groupBy("print").agg(F.min("key").alias("node"), F.count("*").alias("copies"), *first)))
    cells = fitted(nodes, kind)
    found = multiplied(released(nodes), cells, threshold, kind)
    counts = found.filter("to is null").groupBy("node").agg(F.sum("n").alias("n"))
    labels = components(found.filter("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")))
    by_print = nodes.select("print", "node", "copies").join(counts, "node", "left").join(labels, "node", "left")
    by_print = by_print.select("print", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    out = rows.select("key", "print").join(by_print, "print", "left")
    component = F.coalesce("component", "key")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("key") == component).alias("kept"))
