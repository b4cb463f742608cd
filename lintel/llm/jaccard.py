"""n-gram Jaccard join by PartEnum signatures.

A text's set holds the hashes of its distinct word windows. Texts with equal sets are one node.
Sets of a band of sizes that link differ in at most k elements, so if the hash domain is dealt into
n1 parts with n1 * (K2 + 1) > k, in one part at least they differ in K2 elements at most; dealt
again into N2 sub-parts, they agree there on N2 - K2 whole sub-parts. Each choice of so many
sub-parts of a part is hashed into a signature, and a set signs for its own band and for those of
the larger sets that it can link with. So sets that link share a signature, whatever their size.

A signature of no elements says nothing and is shared by chance. So there are spare parts, one or,
at low thresholds, two, and as many parts more agree: what agrees in empty choices only agrees in two or three of them, and
pairs or triples of a set's empty choices are hashed into signatures instead of single ones.

Signatures are sorted by range and then by node, so a signature of any number of nodes spans
several tasks, and are read as a stream that drops those of one node. Each set has a sketch, the parity of its elements in
hashed bits: sets differ in at least as many elements as their sketches do in bits. Pairs of a
signature whose sketches differ too much cannot link and are not tied. First each node meets the
least nodes of its signatures, every such pair once however many signatures have it; a signature
whose nodes hang together by then is done. In the others, all pairs that do not hang together yet
meet. A signature of more than
TILE nodes is cut into blocks, each of which meets PIVOTS of its nodes: a node that is near one is
tied to it, pivots that others are tied to are tied together, and only nodes near no pivot go on to
meet all blocks. So a large group of near copies costs in proportion to its size.

Nodes that hang together through ties are then compared exactly, as products of set matrices, in
blocks of at most SETS sets and about BLOCK elements. A block is compared with itself and PIVOTS
sets of its group; what is then not in the group's largest component is compared with all blocks.
Blocks report a spanning forest of the links they find, never all pairs. Components of those are the result.

Null and wordless texts have no set and link with nothing. Texts are read whole. Rows that share
an id are one node. Rows with a null id are kept without a component. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.batches import M1, M2, U64, checkpointed, distinct_per_row, map_arrow, mix, packed_texts, released, rows_of, shingles, slices, unpacked, word_hashes, words
from lintel.llm.components import components, grouped, least_reachable, starts

N2, K2, WIDTH = 3, 1, 1.25
#: Sets of a block, at most, and elements of it, about.
SETS, BLOCK = 128, 200_000
#: Nodes of a signature whose sketches are compared in one task, and the nodes of a larger one, or of a group, that all others meet.
TILE, PIVOTS = 1024, 8
#: Parts of a band up to which empty choices are hashed in triples and in pairs, as those grow with a power of it.
TRIPLES, PAIRS = 100, 1500
LEAST_BITS = 512


class Bands:
    """Bands of sizes for a threshold of num / den, and the number of first-level parts of each."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.spare = 1 if 20 * num >= 17 * den else 2
        self.low, self.high = [1], [1]

    def up_to(self, size: int) -> None:
        while self.high[-1] < size:
            self.low.append(self.high[-1] + 1)
            self.high.append(max(self.low[-1], int(self.low[-1] * WIDTH)))

    def of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) band that a set of a size signs for."""
        reach = sizes * self.den // self.num
        self.up_to(int(reach.max(initial=1)))
        low = np.array(self.low)
        return np.searchsorted(low, sizes, "right") - 1, np.searchsorted(low, reach, "right") - 1

    def parts(self, band: np.ndarray) -> np.ndarray:
        """n1 of each band, of which one part and the spare ones agree; 0 where only equal sets link."""
        k = 2 * np.array(self.high)[band] * (self.den - self.num) // (self.den + self.num)
        return np.where(k > 0, k // (K2 + 1) + 1 + self.spare, 0)

    def together(self, parts: np.ndarray) -> np.ndarray:
        """How many empty choices make a signature."""
        return np.where(parts <= TRIPLES, 1 + self.spare, np.where(parts <= PAIRS, 2, 1))


def sets_of(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): each text's distinct windows of size words, or its whole shorter sequence."""
    offsets, codes, vocabulary = words(texts)
    row, hashes = shingles(offsets, word_hashes(vocabulary)[codes], size, short=True)
    return distinct_per_row(row, hashes, len(texts))


def signatures(offsets: np.ndarray, hashes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of each set and choice of sub-parts."""
    sizes = np.diff(offsets)
    first, last = bands.of(sizes)
    rows, sigs = [], []
    for step in range(int((last - first).max(initial=-1)) + 1):
        band = first + step
        parts = np.where((band <= last) & (sizes > 0), bands.parts(np.minimum(band, len(bands.low) - 1)), 0)
        base = np.concatenate(([0], np.cumsum(parts)))
        own = np.repeat(parts > 0, sizes)
        row, h = rows_of(offsets)[own], hashes[own]
        spread = mix(h ^ (band[row].astype(U64) * M2))
        part = ((spread >> U64(32)) % parts[row].astype(U64)).astype(np.int64)
        at = (base[row] + part) * N2 + ((spread & U64(0xFFFFFFFF)) % U64(N2)).astype(np.int64)
        total = np.zeros(base[-1] * N2, U64)
        np.add.at(total, at, mix(h + M1))
        total, held = total.reshape(-1, N2), np.bincount(at, minlength=len(total)).reshape(-1, N2)
        who = np.repeat(np.arange(len(sizes)), parts)
        name = (band[who].astype(U64) << U64(40)) + (np.arange(base[-1]) - base[who]).astype(U64) * U64(N2)
        everything = total.sum(1, dtype=U64)
        empty, together = [], bands.together(parts)
        for left_out in range(N2):
            sig = mix(everything - total[:, left_out] + mix(name + U64(left_out)))
            bare = (held.sum(1) == held[:, left_out]) & (together[who] > 1)
            rows.append(who[~bare])
            sigs.append(sig[~bare])
            empty.append(np.flatnonzero(bare) * N2 + left_out)
        empty = np.sort(np.concatenate(empty))
        for size in (2, 3):
            row, sig = choices(empty[together[who[empty // N2]] == size], who, name, size)
            rows.append(row)
            sigs.append(sig)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(sigs).view(np.int64)


def choices(empty: np.ndarray, who: np.ndarray, name: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of each size of a row's empty choices that are of different parts; empty: parts * N2 + what is left out, ascending."""
    own, sig = who[empty // N2], mix(name[empty // N2] + (empty % N2).astype(U64))
    begin = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    counts = np.diff(np.append(begin, len(own)))
    rows, sigs = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for n in np.unique(counts[counts >= size]):
        picks = np.array(list(combinations(range(n), size)))
        at = (begin[counts == n][:, None, None] + picks[None]).reshape(-1, size)
        part = empty[at] // N2
        at = at[(part[:, 1:] != part[:, :-1]).all(1)]
        total = sig[at[:, 0]]
        for k in range(1, size):
            total = total * M1 + sig[at[:, k]]
        rows.append(own[at[:, 0]])
        sigs.append(mix(total))
    return np.concatenate(rows), np.concatenate(sigs)


def sketches(offsets: np.ndarray, hashes: np.ndarray) -> list[bytes]:
    """Of each set, the parities of its elements' counts by hashed bit, in as many bits as elements or up to twice that."""
    bits = LEAST_BITS << np.ceil(np.log2(np.maximum(np.diff(offsets), LEAST_BITS) / LEAST_BITS)).astype(np.int64)
    base = np.concatenate(([0], np.cumsum(bits)))
    row = rows_of(offsets)
    at = base[row] + (mix(hashes ^ M2) & (bits[row] - 1).astype(U64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=base[-1]) & 1).astype(bool), bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(base[:-1], base[1:], strict=True)]


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch in fewer bits, as words; hashed bits are the leading ones' remainders, so halves are added."""
    words_ = np.frombuffer(sketch, U64)
    while len(words_) > size:
        words_ = words_[: len(words_) // 2] ^ words_[len(words_) // 2 :]
    return words_


def fingerprints(offsets: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    """Two sums over each set's mixed elements."""
    out = []
    for salt in (M1, M2):
        total = np.zeros(len(offsets) - 1, U64)
        np.add.at(total, rows_of(offsets), mix(hashes ^ salt))
        out.append(total.view(np.int64))
    return out


def described(documents: DataFrame, size: int) -> DataFrame:
    """node, n, f1, f2 (a fingerprint of the set), sketch of every text; documents: node, text."""

    def make():
        def run(batches):
            for part, texts in slices(batches, "text"):
                offsets, hashes = sets_of(texts, size)
                f1, f2 = fingerprints(offsets, hashes)
                yield {"node": part.column("node"), "n": np.diff(offsets), "f1": f1, "f2": f2, "sketch": sketches(offsets, hashes)}

        return run

    return map_arrow(documents, make, "node bigint, n bigint, f1 bigint, f2 bigint, sketch binary")


def signed(documents: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """sig, node: every set's signatures; node is the first half of its fingerprint. Of equal sets of a slice one signs."""

    def make():
        bands = Bands(num, den)

        def run(batches):
            for _, texts in slices(batches, "text"):
                offsets, hashes = sets_of(texts, size)
                f1, _ = fingerprints(offsets, hashes)
                first = np.zeros(len(texts), bool)
                first[np.unique(f1, return_index=True)[1]] = True
                sizes = np.where(first, np.diff(offsets), 0)
                row, sigs = signatures(np.concatenate(([0], np.cumsum(sizes))), hashes[np.repeat(first, np.diff(offsets))], bands)
                for low in range(0, len(row), 200_000):
                    yield {"sig": sigs[low : low + 200_000], "node": f1[row[low : low + 200_000]]}

        return run

    return map_arrow(documents.filter("node is not null").select("text"), make, "sig bigint, node bigint")


def shared(pairs: DataFrame) -> DataFrame:
    """sig, node: rows of signatures that several nodes have, or could have; pairs: the same of all.

    Rows are dealt by range of both, so partitions cut large signatures; what a partition has of
    the signatures at its ends is kept even if it is one node.
    """

    def make():
        def run(batches: Iterator[pa.RecordBatch]):
            held, begun = pa.table({"sig": pa.array([], pa.int64()), "node": pa.array([], pa.int64())}), False
            for batch in batches:
                if not batch.num_rows:
                    continue
                table = pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
                s, node = table.column("sig").to_numpy(), table.column("node").to_numpy()
                new = np.ones(len(s), bool)
                new[1:] = (s[1:] != s[:-1]) | (node[1:] != node[:-1])
                s, node = s[new], node[new]
                several = np.zeros(len(s), bool)
                several[1:] = s[1:] == s[:-1]
                several[:-1] |= several[1:]
                if not begun:
                    several |= s == s[0]
                    begun = True
                # the last row waits for the next batch
                yield {"sig": s[:-1][several[:-1]], "node": node[:-1][several[:-1]]}
                held = pa.table({"sig": s[-1:], "node": node[-1:]})
                if several[-1]:
                    yield {"sig": s[-1:], "node": node[-1:]}
            yield {"sig": held.column("sig").to_numpy(), "node": held.column("node").to_numpy()}

        return run

    dealt = pairs.repartitionByRange("sig", "node").sortWithinPartitions("sig", "node")
    return map_arrow(dealt, make, "sig bigint, node bigint")


def near(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of nx and ny elements with sketches x and y, a row each, could link."""
    differ = np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)
    return (np.minimum(nx, ny) * den >= np.maximum(nx, ny) * num) & (differ * (den + num) <= (nx + ny) * (den - num))


def forest_of(a: np.ndarray, b: np.ndarray) -> dict:
    """A spanning forest of ties or links, which says as much."""
    node, to = least_reachable(a, b)
    return {"a": node[node != to], "b": to[node != to]}


def gathered(parts: Iterator[dict], most: int = 400_000) -> Iterator[dict]:
    """Forests of ties or links as one forest a task, or a few where it has more than most nodes; a group's ties come once, not once a signature."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part["a"])
        if size > most:
            held = [forest_of(*(np.concatenate([p[c] for p in held]) for c in "ab"))]
            if len(held[0]["a"]) > most // 2:
                yield held.pop()
            size = sum(len(p["a"]) for p in held)
    if held:
        yield forest_of(*(np.concatenate([p[c] for p in held]) for c in "ab"))


def least_ties(each: DataFrame, sketched: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: ties between nodes and the least nodes of their signatures, of which each pair is compared once; each: node, least."""
    pairs = each.filter("node <> least").select("least", "node").distinct()
    blocks = pairs.groupBy("least").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    rows = pairs.join(blocks, "least").select("least", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"), "node")
    heads = blocks.select("least", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"), F.col("least").alias("node"))

    def make():
        def run(tables):
            for table in tables:
                begin = starts(table, ["least", "own"])
                node, n, sketch = table.column("node").to_numpy(), table.column("n").to_numpy(), table.column("sketch")
                head = node == table.column("least").to_numpy()
                rest = np.flatnonzero(~head)
                # a tile has its head once
                to = np.repeat(np.flatnonzero(head), np.diff(np.append(begin, table.num_rows)))[rest]
                size = pc.binary_length(sketch).to_numpy() // 8
                width = np.minimum(size[rest], size[to])
                for w in np.unique(width):
                    i, j = rest[width == w], to[width == w]
                    heads_, at = np.unique(j, return_inverse=True)
                    x, y = (np.stack([folded(k, w) for k in sketch.take(pa.array(those)).to_pylist()]) for those in (i, heads_))
                    close = near(x, y[at], n[i], n[j], num, den)
                    if close.any():
                        yield forest_of(node[i[close]], node[j[close]])

        return run

    tiles = rows.union(heads).join(sketched, "node")
    return grouped(tiles, ["least", "own"], ["node"], lambda: lambda tables: gathered(make()(tables)), "a bigint, b bigint")


def ties(pairs: DataFrame, sketched: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: nodes of one signature that could link, or hang together with such; sketched: node, n, sketch."""
    rows = released(checkpointed(shared(pairs).distinct()))
    sizes = rows.groupBy("sig").agg(F.count("*").alias("nodes"), F.min("node").alias("least")).filter("nodes > 1")
    each = checkpointed(rows.join(sizes, "sig"))
    first = released(checkpointed(least_ties(each, sketched, num, den)))
    labels = checkpointed(components(first))
    labelled = checkpointed(each.join(labels, "node", "left").select("sig", "node", "nodes", F.coalesce("component", "node").alias("label")))
    undone = labelled.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("sig")
    left = labelled.join(undone, "sig", "left_semi")
    small, large = left.filter(F.col("nodes") <= TILE).select("sig", "node", "label").join(sketched, "node"), left.filter(F.col("nodes") > TILE)

    def make():
        def run(tables):
            for table in tables:
                begin = starts(table, ["sig"])
                counts = np.diff(np.append(begin, table.num_rows))
                label, n, sketch = table.column("label").to_numpy(), table.column("n").to_numpy(), table.column("sketch")
                size = pc.binary_length(sketch).to_numpy() // 8
                for width in np.unique(size):
                    # signatures by the shortest sketch among their nodes
                    least = np.minimum.reduceat(size, begin) == width
                    if not least.any():
                        continue
                    at = np.concatenate([np.arange(b, b + c) for b, c in zip(begin[least], counts[least], strict=True)])
                    bits = np.stack([folded(x, width) for x in sketch.take(pa.array(at)).to_pylist()])
                    place = np.cumsum(counts[least]) - counts[least]
                    for nodes in np.unique(counts[least]):
                        u, v = np.triu_indices(nodes, 1)
                        own = place[counts[least] == nodes]
                        step = max(1, 400_000 // max(1, len(u) * width))
                        for low in range(0, len(own), step):
                            i, j = ((own[low : low + step, None] + w[None, :]).ravel() for w in (u, v))
                            open_ = label[at[i]] != label[at[j]]
                            i, j = i[open_], j[open_]
                            for part in range(0, len(i), 1 << 18):
                                a, b = i[part : part + (1 << 18)], j[part : part + (1 << 18)]
                                close = near(bits[a], bits[b], n[at[a]], n[at[b]], num, den)
                                if close.any():
                                    yield forest_of(label[at[a[close]]], label[at[b[close]]])

        return run

    found = first.union(grouped(small, ["sig"], ["node"], lambda: lambda tables: gathered(make()(tables)), "a bigint, b bigint"))
    return found if large.isEmpty() else found.union(large_ties(large, sketched, num, den))


def pivoted(rows: DataFrame, key: str, node: str, carried: list[str]) -> DataFrame:
    """own, key and carried of PIVOTS rows of each key, drawn by hash, once for each of its blocks; rows: these, node and blocks."""
    drawn = rows.groupBy(key, F.pmod(F.xxhash64(node, F.lit(3)), F.lit(PIVOTS)).alias("class")).agg(F.min_by(F.struct(node, *carried, "blocks"), F.xxhash64(node, F.lit(5))).alias("p"))
    return drawn.select(key, "p.*").select(key, node, *carried, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))


def large_ties(large: DataFrame, sketched: DataFrame, num: int, den: int) -> DataFrame:
    """Ties between labels, for signatures of more than TILE nodes; large: sig, node, nodes, label."""
    blocks = F.ceil(F.col("nodes") / TILE).cast("int")
    rows = checkpointed(large.join(sketched, "node").select("sig", "node", "label", "n", "sketch", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own")))
    columns = ["sig", "own", "node", "label", "n", "sketch"]
    tiles = rows.select(*columns, F.lit(False).alias("marked")).union(pivoted(rows, "sig", "node", ["label", "n", "sketch"]).select(*columns, F.lit(True)))

    def apart(keys: list[str]):
        """(first column of keys, nodes, labels, sketches as words, sizes, nodes marked) of each tile."""

        def run(tables):
            for table in tables:
                begin = [*starts(table, keys), table.num_rows]
                for a, b in zip(begin[:-1], begin[1:], strict=True):
                    part = table.slice(a, b - a)
                    width = int(pc.min(pc.binary_length(part.column("sketch"))).as_py()) // 8
                    yield int(part.column("sig")[0].as_py()), part.column("node").to_numpy(), part.column("label").to_numpy(), np.stack([folded(x, width) for x in part.column("sketch").to_pylist()]), part.column("n").to_numpy(), part.column("marked").to_numpy(zero_copy_only=False).astype(bool)

        return run

    def met(node, bits, n, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which of the rows left could link with which of right, other than themselves."""
        out = np.zeros((len(left), len(right)), bool)
        step = max(1, (1 << 20) // max(1, len(right) * bits.shape[1]))
        for low in range(0, len(left), step):
            i = left[low : low + step]
            out[low : low + step] = near(bits[i][:, None], bits[right][None], n[i][:, None], n[right][None], num, den)
        return out & (node[left][:, None] != node[right][None])

    def make():
        def run(tables):
            for sig, node, label, bits, n, marked in apart(["sig", "own"])(tables):
                pivots, rest = np.flatnonzero(marked), np.flatnonzero(~marked)
                close = met(node, bits, n, rest, pivots)
                tied = close.any(1)
                u, v = np.nonzero(close)
                used = np.unique(label[pivots[v]])
                links = forest_of(label[rest[u]], label[pivots[v]]) if len(u) else {"a": node[:0], "b": node[:0]}
                # kinds: ties, labels of pivots in use, and nodes that are left
                kinds = [(links["a"], links["b"], 0), (used, used, 1), (node[rest[~tied]], node[rest[~tied]], 2)]
                yield {
                    "sig": np.full(sum(len(a) for a, _, _ in kinds), sig),
                    "a": np.concatenate([a for a, _, _ in kinds]),
                    "b": np.concatenate([b for _, b, _ in kinds]),
                    "kind": np.concatenate([np.full(len(a), k) for a, _, k in kinds]),
                }

        return run

    found = checkpointed(grouped(tiles, ["sig", "own"], ["node"], make, "sig bigint, a bigint, b bigint, kind int"))
    used = found.filter("kind = 1").groupBy("sig").agg(F.min("a").alias("a"), F.collect_set("b").alias("all")).select("a", F.explode("all").alias("b")).filter("a <> b")
    out = found.filter("kind = 0").select("a", "b").union(used)
    left = found.filter("kind = 2").select("sig", F.col("a").alias("node"))
    if left.isEmpty():
        return out
    counts = left.groupBy("sig").agg(F.ceil(F.count("*") / TILE).cast("int").alias("left_blocks"))
    all_ = rows.join(counts, "sig")
    every = all_.select("sig", F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1)).alias("i"), F.col("own").alias("j"), "node", "label", "n", "sketch", F.lit(False).alias("marked"))
    those = all_.join(left, ["sig", "node"]).select("sig", F.pmod(F.xxhash64("node", F.lit(9)), F.col("left_blocks")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "node", "label", "n", "sketch", F.lit(True).alias("marked"))

    def make_left():
        def run(tables):
            for _, node, label, bits, n, marked in apart(["sig", "i", "j"])(tables):
                ours, others = np.flatnonzero(marked), np.flatnonzero(~marked)
                u, v = np.nonzero(met(node, bits, n, ours, others))
                if len(u):
                    yield forest_of(label[ours[u]], label[others[v]])

        return run

    return out.union(grouped(every.union(those), ["sig", "i", "j"], ["node"], lambda: lambda tables: gathered(make_left()(tables)), "a bigint, b bigint"))


def linked(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of sets whose Jaccard similarity is num / den or more; exact."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return (np.zeros(1, np.int64), np.ones(1, np.int64)) if den * both >= num * (sizes.sum() - both) else (np.zeros(0, np.int64),) * 2
    both = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers of up to 2^24
    _, found, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = (n > 1)[found]
    column = (np.cumsum(n > 1) - 1)[found[shared]]
    row = np.repeat(np.arange(len(sets)), sizes)[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(64, (4 << 20) // len(sets))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        x = np.zeros((len(sets), min(width, int(column[-1]) + 1 - low)), np.float32)
        x[row[a:b], column[a:b] - low] = 1
        both += x @ x.T
    out = []
    for low in range(0, len(sets), 256):
        i = np.arange(low, min(low + 256, len(sets)))
        own = both[i].astype(np.float64)
        hit = (den * own >= num * (sizes[i][:, None] + sizes[None, :] - own)) & (i[:, None] < np.arange(len(sets))[None, :])
        u, v = np.nonzero(hit)
        out.append((u + low, v))
    return np.concatenate([u for u, _ in out]), np.concatenate([v for _, v in out])


def compared_tiles(tiles: DataFrame, keys: list[str], num: int, den: int) -> DataFrame:
    """a, b: a spanning forest of the links within each tile; tiles: keys, node, elements. A node may be there twice."""

    def make():
        def run(tables):
            for table in tables:
                begin = [*starts(table, keys), table.num_rows]
                nodes, elements = table.column("node").to_numpy(), table.column("elements")
                for a, b in zip(begin[:-1], begin[1:], strict=True):
                    own, first = np.unique(nodes[a:b], return_index=True)
                    if len(own) > 1:
                        u, v = linked([np.frombuffer(x, U64) for x in elements.take(pa.array(first + a)).to_pylist()], num, den)
                        yield forest_of(own[u], own[v])

        return run

    return grouped(tiles, keys, ["node"], lambda: lambda tables: gathered(make()(tables)), "a bigint, b bigint")


def compared(members: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """node, component: components of the links within each group; members: grp, blocks, node, packed."""

    def make_sets():
        def run(batches):
            for part, texts in slices(unpacked(batches), "text"):
                offsets, hashes = sets_of(texts, size)
                yield {c: part.column(c) for c in ("grp", "blocks", "node")} | {"elements": [hashes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]}

        return run

    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own")
    rows = released(checkpointed(map_arrow(members, make_sets, "grp bigint, blocks int, node bigint, elements binary").select("grp", "blocks", own, "node", "elements")))
    columns = ["grp", "own", "node", "elements"]
    several = rows.filter("blocks > 1")
    if several.isEmpty():
        return components(compared_tiles(rows.select(columns), ["grp", "own"], num, den))
    tiles = rows.select(columns).union(pivoted(several, "grp", "node", ["elements"]).select(columns))
    first = checkpointed(compared_tiles(tiles, ["grp", "own"], num, den))
    labels = checkpointed(components(first))
    # of a group of several blocks, what is not in its largest component meets all blocks
    each = several.select("grp", "node", "blocks", F.length("elements").alias("bytes")).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    most = each.groupBy("grp", "component").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max_by("component", "n").alias("largest"))
    left = checkpointed(each.join(most, "grp").filter("component <> largest").select("grp", "node", "bytes"))
    if left.isEmpty():
        return labels
    counts = left.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / SETS), F.ceil(F.sum("bytes") / (8 * BLOCK))).cast("int").alias("left_blocks"))
    all_ = several.join(counts, "grp")
    every = all_.select("grp", F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1)).alias("i"), F.col("own").alias("j"), "node", "elements")
    those = all_.join(left.select("grp", "node"), ["grp", "node"]).select("grp", F.pmod(F.xxhash64("node", F.lit(9)), F.col("left_blocks")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "node", "elements")
    return components(first.union(compared_tiles(every.union(those), ["grp", "i", "j"], num, den)))


def joined(documents: DataFrame, size: int = 5, num: int = 80, den: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles, component_id of every row; component_id is the least key reachable by links."""
    texts = documents.select(F.col(key).cast("long").alias("node"), F.col(text).alias("text"))
    base = checkpointed(described(texts, size))
    has = (F.col("n") > 0) & F.col("node").isNotNull()
    # until their texts are needed, equal sets go by the first half of their fingerprint
    sketched = base.filter(has).groupBy(F.col("f1").alias("node")).agg(F.max("n").alias("n"), F.first("sketch").alias("sketch"))
    tied = released(checkpointed(ties(signed(texts, size, num, den), sketched, num, den)))
    coarse = checkpointed(components(tied).select(F.col("node").alias("f1"), F.col("component").alias("grp")))
    groups = checkpointed(base.filter(has).groupBy("f1", "f2", "n").agg(F.min("node").alias("rep")))
    sized = groups.join(coarse, "f1")
    blocks = F.greatest(F.ceil(F.count("*") / SETS), F.ceil(F.sum("n") / BLOCK)).cast("int")
    totals = sized.groupBy("grp").agg(blocks.alias("blocks"))
    members = packed_texts(texts, "node", "text").join(sized.join(totals, "grp").select(F.col("rep").alias("node"), "grp", "blocks").distinct(), "node")
    labels = compared(members, size, num, den)
    released(groups)
    found = groups.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("f1", "f2", "n", F.coalesce("component", "rep").alias("component"))
    # rows that share an id are one node, whatever their texts
    same = base.filter(has).select("node", "f1", "f2", "n").distinct().groupBy("node").agg(F.count("*").alias("sets")).filter("sets > 1")
    if not same.isEmpty():
        return relinked(base, has, found, key)
    out = base.drop("sketch").join(found, ["f1", "f2", "n"], "left")
    return out.select(F.col("node").alias(key), F.col("n").alias("n_shingles"), F.when(has, F.coalesce("component", "node")).otherwise(F.col("node")).alias("component_id"))


def relinked(base: DataFrame, has, found: DataFrame, key: str) -> DataFrame:
    """The result where an id has several sets: their components are one."""
    rows = checkpointed(base.drop("sketch").join(found, ["f1", "f2", "n"], "left").select("node", "n", F.when(has, F.coalesce("component", "node")).otherwise(F.col("node")).alias("component")))
    labels = components(rows.filter("component is not null").select(F.col("node").alias("a"), F.col("component").alias("b"))).withColumnRenamed("component", "least")
    return rows.join(labels, "node", "left").select(F.col("node").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "node").alias("component_id"))
