"""Removal of long repeated byte strings by run-length compressed Burrows-Wheeler indexes.

A byte goes if a string of SPAN bytes that covers it also starts earlier: in a row with a smaller
id, or earlier in the same one. Whether it does is decided for each start, in three steps.

1. Each start of SPAN bytes belongs to the least hash of the KMER bytes strings within them, so
   equal strings belong to the same hash. Neighbouring starts with one hash, in one place, are a run. Runs are
   sorted by hash, content and place: a run with the content of an earlier one repeats it wholly.
   Slices drop such runs by themselves first, so a passage that is everywhere is shuffled once for each
   slice and not for each document. Hashes with one content only are done with.
2. The remaining contents are fetched and dealt by hash into shards of about SHARD bytes, each in the order of
   places. A shard is indexed: the runs of equal characters in its Burrows-Wheeler transform are found,
   and where a run begins the position, the position before it in suffix order and the length that
   both share are sampled; nothing else is kept.
3. Streaming over the shard, the matching statistic of each position and the place it matches follow
   from the last sample before it. Positions that match SPAN bytes or more hang together in chains,
   whose first place is the earliest occurrence; the strings at all others go.

A hash of more than MANY contents would outgrow a shard. Its strings are dealt anew by longer
strings within them, in the end by themselves as a whole, and go through the same steps.

Null texts count as empty. Texts may be of any length and are hashed in overlapping windows. Rows that share an id are read as one after
the other in the order of their texts' hashes: where there are any, all rows are sorted and numbered,
and the numbers stand for the ids. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.batches import M1, U64, checkpointed, fresh, map_arrow, mix, packed_texts, released, slices, text_bytes, unpacked, written
from lintel.llm.components import grouped, starts

SPAN, KMER, SHARD = 100, 32, 1 << 20
#: Bytes of text whose hashes a task holds at a time, about, as they take some sixty times as much memory;
#: and bytes of text among whose runs it looks for repeats before it passes them on.
HASHED, COMBINED = 1 << 20, 8 << 20
#: Contents of a hash, of less than two SPAN bytes each, that a shard takes.
MANY = 20_000
SEPARATOR = 0xFF  # in no UTF-8 text
#: Bits that tell places in a window or slice apart, which are far smaller.
PLACE = U64((1 << 28) - 1)


def powers(n: int) -> int:
    return pow(int(M1), n, 1 << 64)


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each size bytes, put together from powers of two."""
    n = len(data) - size + 1
    out, done, current, width = np.zeros(max(n, 0), U64), 0, data.astype(U64) + U64(1), 1
    while n > 0:
        if size & width:
            out = out * U64(powers(width)) + current[done : done + n]
            done += width
        if width * 2 > size:
            break
        current = current[:-width] * U64(powers(width)) + current[width:]
        width *= 2
    return mix(out)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of width neighbours."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :])


def runs(offsets: np.ndarray, data: np.ndarray, span: int, kmer: int) -> tuple[np.ndarray, ...]:
    """(hash, row, first start, starts) of each run; starts count from 0 in the row.

    A run's starts share not just the hash but the place of its leftmost occurrence, so strings of one run differ.
    """
    if len(data) < span:
        return (np.zeros(0, np.int64),) * 4
    hashes = rolling(data, kmer)
    # the least by leading bits of the hash, then by place
    placed = (hashes & ~PLACE) | (np.arange(len(hashes), dtype=U64) & PLACE)
    lowest = least(placed, span - kmer + 1)
    start = np.arange(len(lowest))
    row = np.searchsorted(offsets, start, "right") - 1
    own = start + span <= offsets[row + 1]
    start, row, lowest = start[own], row[own], lowest[own]
    new = np.ones(len(start), bool)
    new[1:] = (lowest[1:] != lowest[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    key = hashes[(lowest[at] & PLACE).astype(np.int64)]
    return key.view(np.int64), row[at], start[at] - offsets[row[at]], np.diff(np.append(at, len(start)))


def windows(offsets: np.ndarray, data: np.ndarray, span: int, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first place, offsets, bytes) of a slice, which may be one long text: that is cut, so that each span bytes lie in one window."""
    if len(offsets) == 2 and len(data) > limit + span:
        for low in range(0, len(data) - span + 1, limit):
            own = data[low : low + limit + span - 1]
            yield low, np.array([0, len(own)]), own
    else:
        yield 0, offsets, data


def run_rows(texts: DataFrame, span: int, kmer: int) -> DataFrame:
    """hash, content, doc_id, start, n: n starts from start on; content null: they are repeats already. texts: doc_id, at, bytes."""

    def combined(parts: list[tuple[np.ndarray, ...]]) -> dict:
        key, content, doc, start, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((start, doc, content, key))
        key, content, doc, start, n = key[order], content[order], doc[order], start[order], n[order]
        again = np.zeros(len(key), bool)
        again[1:] = (key[1:] == key[:-1]) & (content[1:] == content[:-1])
        # repeats need no company: they are dealt by their document
        return {"hash": np.where(again, doc * 7919, key), "content": pa.array(content, mask=again), "doc_id": doc, "start": start, "n": n}

    def make():
        def run(batches):
            held, size = [], 0
            for part, own in slices(batches, "bytes", HASHED, pa.binary()):
                doc, at = part.column("doc_id").to_numpy(), part.column("at").to_numpy()
                for low, offsets, data in windows(*text_bytes(own), span, HASHED):
                    key, row, start, n = runs(offsets, data, span, kmer)
                    view = memoryview(data)
                    begin = (offsets[row] + start).tolist() if len(row) else []
                    content = np.fromiter((xxhash.xxh3_64_intdigest(view[b : b + m]) for b, m in zip(begin, (n + span - 1).tolist(), strict=True)), U64, len(n)).view(np.int64)
                    held.append((key, content, doc[row], (start + at[row] + low).astype(np.int32), n.astype(np.int32)))
                    size += len(data)
                    if size >= COMBINED:
                        yield combined(held)
                        held, size = [], 0
            if held:
                yield combined(held)

        return run

    return map_arrow(texts.select("doc_id", F.col("at").cast("int").alias("at"), F.col("bytes").cast("binary").alias("bytes")), make, "hash bigint, content bigint, doc_id bigint, start int, n int")


def sifted(rows: DataFrame) -> DataFrame:
    """doc_id, start, n, hash: repeats with a null hash, and the contents of hashes that have several.

    A stream over sorted rows: it holds a batch and the first row of the current hash.
    """

    def make():
        def run(batches: Iterator[pa.RecordBatch]):
            last_hash, last_content, waiting = None, None, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                known = batch.column("content").is_null().to_numpy(zero_copy_only=False)
                key, doc, start, n = (batch.column(c).to_numpy() for c in ("hash", "doc_id", "start", "n"))
                content = batch.column("content").fill_null(0).to_numpy()
                out = [(doc[known], start[known], n[known], np.full(known.sum(), 0), np.ones(known.sum(), bool))]
                key, doc, start, n, content = key[~known], doc[~known], start[~known], n[~known], content[~known]
                if len(key):
                    same_key = np.ones(len(key), bool)
                    same_key[1:] = key[1:] == key[:-1]
                    same_key[0] = key[0] == last_hash
                    same_content = same_key.copy()
                    same_content[1:] &= content[1:] == content[:-1]
                    same_content[0] &= bool(content[0] == last_content)
                    # a hash's first content is told apart once a second one follows
                    second = same_key & ~same_content
                    first = np.maximum.accumulate(np.where(~same_key, np.arange(len(key)), -1))
                    several = np.unique(first[second])
                    if waiting is not None and len(several) and several[0] == -1:
                        out.append(tuple(np.array([x]) for x in waiting) + (np.zeros(1, bool),))
                        waiting = None
                    several = several[several >= 0]
                    pick = second.copy()
                    pick[several] = True
                    out.append((doc[pick], start[pick], n[pick], key[pick], np.zeros(pick.sum(), bool)))
                    out.append((doc[same_content], start[same_content], n[same_content], key[same_content], np.ones(same_content.sum(), bool)))
                    last_hash, last_content = key[-1], content[-1]
                    if first[-1] >= 0:
                        i = first[-1]
                        waiting = None if len(several) and several[-1] == i else (doc[i], start[i], n[i], key[i])
                doc, start, n, key, repeat = (np.concatenate(x) for x in zip(*out, strict=True))
                yield {"doc_id": doc, "start": start, "n": n, "hash": pa.array(key, mask=repeat)}

        return run

    dealt = rows.repartition("hash").sortWithinPartitions("hash", "content", "doc_id", "start")
    return map_arrow(dealt, make, "doc_id bigint, start int, n int, hash bigint")


def contents(documents: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """hash, many, doc_id, start, bytes of the wanted runs."""
    by_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("hash", "many", "start", "n")).alias("runs"))

    def make():
        def run(batches):
            for part, texts in slices(unpacked(batches), "text"):
                offsets, data = text_bytes(texts)
                doc = part.column("doc_id").to_numpy()
                lists = part.column("runs")
                at = lists.offsets.to_numpy().astype(np.int64)
                flat = lists.values
                key, many, start, n = (flat.field(c).to_numpy(zero_copy_only=False)[at[0] : at[-1]] for c in ("hash", "many", "start", "n"))
                row = np.repeat(np.arange(len(doc)), np.diff(at))
                begin = (offsets[row] + start).tolist()
                whole = data.tobytes()
                yield {"hash": key, "many": many, "doc_id": doc[row], "start": start, "bytes": pa.array([whole[b : b + m] for b, m in zip(begin, (n + span - 1).tolist(), strict=True)], pa.binary())}

        return run

    return map_arrow(packed_texts(documents, "doc_id", "text").join(by_doc, "doc_id"), make, "hash bigint, many boolean, doc_id bigint, start int, bytes binary")


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling; only suffixes that are not yet told apart are sorted again."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    packed = np.zeros(n, U64)
    for k in range(8):
        packed = (packed << U64(8)) | padded[k : k + n]
    short = np.minimum(n - np.arange(n), 8)
    order = np.lexsort((short, packed))
    new = np.ones(n, bool)
    new[1:] = (packed[order[1:]] != packed[order[:-1]]) | (short[order[1:]] != short[order[:-1]])
    rank = np.empty(n + 1, np.int64)
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = group
    rank[n] = -1
    width = 8
    while True:
        alone = new & np.append(new[1:], True)
        left = np.flatnonzero(~alone)
        if not len(left):
            return order
        own = order[left]
        key = rank[own] * np.int64(n + 2) + rank[np.minimum(own + width, n)] + 1
        by = np.argsort(key, kind="stable")
        order[left], key = own[by], key[by]
        fresh = np.ones(len(left), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[left] = fresh
        rank[order[left]] = np.maximum.accumulate(np.where(fresh, left, 0))
        width *= 2


def shared_length(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, a chunk of bytes at a time."""
    n, chunk = len(text), 64
    padded = np.concatenate((text, np.zeros(chunk, np.uint8)))
    window = np.lib.stride_tricks.sliding_window_view(padded, chunk)
    out = np.zeros(len(a), np.int64)
    for low in range(0, len(a), 1 << 17):
        live = np.arange(low, min(low + (1 << 17), len(a)))
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            room = n - np.maximum(x, y)
            differ = window[np.minimum(x, n)] != window[np.minimum(y, n)]
            k = np.where(differ.any(1), differ.argmax(1), chunk)
            k = np.minimum(k, room)
            out[live] += k
            live = live[(k == chunk) & (room > chunk)]
    return out


class RunIndex:
    """A run-length compressed transform of a text: samples where its runs begin, in the order of the text."""

    def __init__(self, text: np.ndarray):
        self.size = len(text)
        order = suffix_order(text)
        before = text[order - 1].astype(np.int16)
        before[order == 0] = -1  # no character
        head = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        at, behind = order[head], np.append(-1, order[head[1:] - 1])
        length = np.append(0, shared_length(text, at[1:], behind[1:]))
        by = np.argsort(at)
        #: Position of each run's first suffix, of the suffix before it (none: -1), and how long both are equal.
        self.at, self.behind, self.length = at[by], behind[by], length[by]

    def streamed(self) -> tuple[np.ndarray, np.ndarray]:
        """By position: the suffix before it in suffix order (where none is, any), and how long both are equal.

        Inside a run both suffixes have the same character ahead, so from one position to the next
        the suffix before moves along by one and the match is shorter by one.
        """
        place = np.arange(self.size)
        i = np.searchsorted(self.at, place, "right") - 1
        # the text's first position begins a run, as no other suffix has no character ahead
        return self.behind[i] + place - self.at[i], self.length[i] - (place - self.at[i])

    def earliest(self, span: int) -> np.ndarray:
        """By position: the first one of those with the same span characters; itself where fewer are left."""
        behind, length = self.streamed()
        place = np.arange(self.size)
        root = np.where(length >= span, behind, place)
        live = np.flatnonzero(root != place)
        while len(live):
            after = root[root[live]]
            live, after = live[after != root[live]], after[after != root[live]]
            root[live] = after
        first = place.copy()
        np.minimum.at(first, root, place)
        return first[root]


def later(doc: np.ndarray, start: np.ndarray, strings: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of the span-byte strings that occur in an earlier place among the strings, which are in the order of places."""
    joined = np.frombuffer(bytes([SEPARATOR]).join(strings), np.uint8)
    if len(joined) < span:
        return doc[:0], start[:0]
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    repeated = np.flatnonzero(RunIndex(joined).earliest(span) < np.arange(len(joined)))
    which = np.searchsorted(begin, repeated, "right") - 1
    inside = repeated + span <= (begin + sizes)[which]
    repeated, which = repeated[inside], which[inside]
    return doc[which], start[which] + repeated - begin[which]


def compared(found: DataFrame, span: int) -> DataFrame:
    """doc_id, start, n: repeats among the contents of each hash, shard by shard."""

    def make():
        def shards(table: pa.Table):
            size = np.cumsum(pc.binary_length(table.column("bytes")).to_numpy())
            begin = starts(table, ["hash"])
            at = 0
            while at < table.num_rows:
                base = size[at - 1] if at else 0
                ends = begin[(begin > at) & (size[begin - 1] - base >= SHARD)] if len(begin) else begin
                end = int(ends[0]) if len(ends) else table.num_rows
                yield table.slice(at, end - at)
                at = end

        def run(tables):
            for table in tables:
                for shard in shards(table):
                    doc, start = later(shard.column("doc_id").to_numpy(), shard.column("start").to_numpy().astype(np.int64), shard.column("bytes").to_pylist(), span)
                    order = np.lexsort((start, doc))
                    doc, start = doc[order], start[order]
                    new = np.ones(len(doc), bool)
                    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
                    at = np.flatnonzero(new)
                    yield {"doc_id": doc[at], "start": start[at], "n": np.diff(np.append(at, len(doc)))}

        return run

    return grouped(found, ["hash"], ["doc_id", "start"], make, "doc_id bigint, start int, n int")


def spans(documents: DataFrame, span: int = SPAN, kmer: int = KMER) -> DataFrame:
    """doc_id, spans: sorted starts and ends of the bytes that go, for rows that lose any. documents: doc_id, text."""
    texts = documents.select("doc_id", F.lit(0).alias("at"), F.coalesce("text", F.lit("")).alias("bytes"))
    every = []
    for size in [*range(kmer, span, kmer), span]:
        known = checkpointed(sifted(run_rows(texts, span, size)))
        released(known)
        every.append(known.filter("hash is null").select("doc_id", "start", "n"))
        several = known.filter("hash is not null")
        sizes = several.groupBy("hash").agg((F.count("*") > MANY).alias("many"))
        found = contents(documents, several.join(sizes, "hash"), span)
        if size == span or sizes.filter("many").isEmpty():
            every.append(compared(found, span))
            break
        found = checkpointed(found)
        every.append(compared(found.filter("not many"), span))
        texts = found.filter("many").select("doc_id", F.col("start").alias("at"), "bytes")
    return reduce(DataFrame.union, every).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("n") + (span - 1)).alias("end")))).alias("spans"))


def merged(pairs: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted spans without overlaps; touching ones are one."""
    out: list[tuple[int, int]] = []
    for x in pairs or ():
        if out and x["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], x["end"]))
        else:
            out.append((x["start"], x["end"]))
    return out


def without(data: bytes, cut: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in cut:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def whole_characters(data: bytes, cut: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the parts of characters at their ends."""
    out = []
    for a, b in cut:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def placed(documents: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """documents and, under name, a number of its own for each row with an id, in the order of ids; whether it is other than the id."""
    own = F.col("doc_id").cast("long")
    if documents.select(own.alias("k")).filter("k is not null").groupBy("k").count().filter("count > 1").isEmpty():
        return documents.withColumn(name, own), False
    h, i = fresh(documents, "own_hash"), fresh(documents, "own_place")
    # equal rows are told apart by where they lie, so that no task gets all of them
    rows = documents.withColumn(h, F.xxhash64("text")).withColumn(i, F.monotonically_increasing_id()).orderBy(own, h, i)
    return written(rows.withColumn(name, F.when(own.isNotNull(), F.monotonically_increasing_id())).drop(h, i)), True


def removed(documents: DataFrame, span: int = SPAN, name: str = "own_spans") -> DataFrame:
    """All columns of documents and, under name, the sorted spans that go, null where nothing does."""
    place, key = fresh(documents, "own_row"), fresh(documents, "own_id")
    rows, _ = placed(documents, place)
    own = rows.select(F.col(place).alias("doc_id"), "text").filter(F.col("doc_id").isNotNull())
    found = spans(own, span).select(F.col("doc_id").alias(key), F.col("spans").alias(name))
    return rows.join(found, rows[place] == F.col(key), "left").drop(key, place)


def digests(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every text."""

    def make():
        def run(batches):
            for part, texts in slices(unpacked(batches), "text"):
                out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
                for text, own in zip(texts.to_pylist(), part.column("own_spans").to_pylist(), strict=True):
                    data, cut = text.encode(), merged(own)
                    out["n_bytes"].append(len(data))
                    out["n_removed"].append(sum(b - a for a, b in cut))
                    out["n_spans"].append(len(cut))
                    out["kept_sha256"].append(hashlib.sha256(without(data, cut)).hexdigest())
                yield {"doc_id": part.column("doc_id")} | out

        return run

    rows, numbered = placed(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "own_row")
    own = rows.select(F.col("own_row").alias("doc_id"), "text")
    found = spans(own.filter("doc_id is not null"), span).select("doc_id", F.col("spans").alias("own_spans"))
    out = map_arrow(packed_texts(own, "doc_id", "text").join(found, "doc_id", "left"), make, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    if not numbered:
        return out
    ids = rows.filter("own_row is not null").select("own_row", F.col("doc_id").alias("own_id"))
    return out.join(ids, out["doc_id"] == ids["own_row"], "left").select(F.col("own_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def shortened(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """documents with their texts less the repeated bytes; characters that are only partly covered stay. n_chars follows, if there."""
    name, columns = fresh(documents, "own_spans"), documents.columns

    def one(text: str | None, own: list[dict] | None) -> str | None:
        if text is None or own is None:
            return text
        data = text.encode()
        return without(data, whole_characters(data, merged(own))).decode()

    def make():
        def run(batches):
            for part, _ in slices(batches, "text"):
                out = {c: part.column(c) for c in columns}
                out["text"] = [one(t, s) for t, s in zip(part.column("text").to_pylist(), part.column(name).to_pylist(), strict=True)]
                if "n_chars" in out:
                    out["n_chars"] = [t if t is None else len(t) for t in out["text"]]
                yield out

        return run

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return map_arrow(removed(documents, span, name), make, fields)
