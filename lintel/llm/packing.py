"""Bounded-space online packing of documents into token windows.

Each input partition keeps OPEN windows. A piece goes to the window it fits best; when it fits in
none, the fullest window is topped up with the piece's head, unless it lacks SLACK tokens or fewer,
and is emitted. At the end a partition settles its open windows among themselves, which leaves it
one window at most; those leftovers are merged the same way in groups of GROUP partitions, then in
groups of GROUP groups, and so on to one, so no task holds more than GROUP windows.

Null texts count as empty: such a document is its end id alone. Repeated rows are packed as often
as they occur; an empty table gives no pieces; further columns of the input are ignored. A
document of any length is cut into pieces of at most a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lintel.llm.batches import checkpointed, crc_of_ids, map_arrow, slices
from lintel.llm.tokens import tokenizer

WINDOW, OPEN, SLACK, GROUP, END_ID = 4096, 32, 8, 128, 2
COLUMNS = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
#: Sequences of one partition or merge, at most.
SPAN = 1 << 36
#: Sequences of each level of merges lie above those of the one before, and of all partitions.
LEVEL = 1 << 59

Piece = tuple[int, int, np.ndarray, int]


class Packer:
    """Open windows; full ones go to out as lists of (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int, open_windows: int, slack: int):
        self.window, self.limit, self.slack = window, open_windows, slack
        self.open: list[tuple[int, list[Piece]]] = []  # (free tokens, pieces)
        self.out: list[list[Piece]] = []

    def add(self, doc: int, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.window:
            self.out.append([(doc, start, ids[: self.window], total)])
            ids, start = ids[self.window :], start + self.window
        while len(ids):
            fits = [(free, i) for i, (free, _) in enumerate(self.open) if free >= len(ids)]
            if fits:
                free, i = min(fits)
                self.open[i][1].append((doc, start, ids, total))
                if free == len(ids):
                    self.out.append(self.open.pop(i)[1])
                else:
                    self.open[i] = (free - len(ids), self.open[i][1])
                return
            if len(self.open) < self.limit:
                self.open.append((self.window - len(ids), [(doc, start, ids, total)]))
                return
            free, pieces = self.open.pop(min(range(len(self.open)), key=lambda i: self.open[i][0]))
            if free > self.slack:
                pieces.append((doc, start, ids[:free], total))
                ids, start = ids[free:], start + free
            self.out.append(pieces)

    def settle(self) -> None:
        """Refills the open windows, fullest first, from the emptiest; one is left at most."""
        self.open.sort(key=lambda x: x[0])
        while len(self.open) > 1:
            free, pieces = self.open[0]
            room, donors = self.open[-1]
            if free <= self.slack:
                self.out.append(self.open.pop(0)[1])
                continue
            doc, start, ids, total = donors.pop()
            taken = ids[: free]
            pieces.append((doc, start, taken, total))
            if len(taken) < len(ids):
                donors.append((doc, start + len(taken), ids[len(taken) :], total))
            self.open[0] = (free - len(taken), pieces)
            self.open[-1] = (room + len(taken), donors)
            if not donors:
                self.open.pop()
            if self.open[0][0] == 0:
                self.out.append(self.open.pop(0)[1])


def rows(sequences: list[list[Piece]], first: int, carry: bool, task: int) -> dict:
    out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "task", "ids")}
    for n, pieces in enumerate(sequences):
        at = 0
        for doc, start, ids, total in pieces:
            values = (doc, start, len(ids), crc_of_ids(ids), total, first + n, at, task, ids.astype("<u4").tobytes() if carry else None)
            for column, value in zip(out.values(), values, strict=True):
                column.append(value)
            at += len(ids)
    return out


def packed_partitions(documents: DataFrame, path: str, window: int, open_windows: int, slack: int) -> DataFrame:
    """COLUMNS, task, ids: the pieces of each partition; ids only where the window is its leftover."""

    def make():
        encode = tokenizer(path, __name__)

        def run(batches) -> Iterator[dict]:
            task = TaskContext.get().partitionId()
            packer, done = Packer(window, open_windows, slack), 0
            for part, texts in slices(batches, "text", 4 << 20):
                offsets, ids = encode(texts, END_ID)
                for doc, a, b in zip(part.column("doc_id").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                    packer.add(doc, 0, ids[a:b].copy() if b - a < window else ids[a:b], int(b - a))
                yield rows(packer.out, task * SPAN + done, False, task)
                done, packer.out = done + len(packer.out), []
            packer.settle()
            yield rows(packer.out, task * SPAN + done, False, task)
            yield rows([pieces for _, pieces in packer.open], 0, True, task)

        return run

    return map_arrow(documents.select("doc_id", "text"), make, f"{COLUMNS}, task int, ids binary")


def merged(leftovers: DataFrame, base: int, window: int, slack: int, last: bool) -> DataFrame:
    """Leftovers of each GROUP tasks packed together; ids stay with the one window that is left, unless last."""
    target = to_arrow_schema(StructType.fromDDL(f"{COLUMNS}, task int, ids binary"))
    size, names = GROUP, [f.name for f in target]

    def merge(pieces: pa.Table) -> pa.Table:
        # as whole numbers all the way: a float would round ids beyond 2^53
        own = sorted(zip(*(pieces.column(c).to_pylist() for c in ("task", "offset", "doc_id", "start", "ids", "doc_tokens")), strict=True), key=lambda r: r[:2])
        group = own[0][0] // size
        packer = Packer(window, len(own) + 1, slack)
        for _, items in groupby(own, key=lambda r: r[0]):
            items = [(doc, start, np.frombuffer(ids, "<u4"), total) for _, _, doc, start, ids, total in items]
            packer.open.append((window - sum(len(x[2]) for x in items), items))
        packer.settle()
        ended, left = packer.out, [p for _, p in packer.open]
        parts = [rows(ended + left if last else ended, base + group * SPAN, False, group), rows([] if last else left, 0, True, group)]
        return pa.Table.from_arrays([pa.array(parts[0][c] + parts[1][c], f.type) for c, f in zip(names, target, strict=True)], schema=target)

    return leftovers.groupBy(F.floor(F.col("task") / GROUP)).applyInArrow(merge, f"{COLUMNS}, task int, ids binary")


def pack(documents: DataFrame, path: str | None = None, window: int = WINDOW, open_windows: int = OPEN, slack: int = SLACK) -> DataFrame:
    """COLUMNS of every piece: what document, which of its ids, their CRC-32, in which sequence and where in it."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    found = checkpointed(packed_partitions(documents, path, window, open_windows, slack))
    open_, columns = F.col("ids").isNotNull(), [x.split()[0] for x in COLUMNS.split(", ")]
    out, level, last = found.filter(~open_).select(columns), 1, False
    while not last:
        left = found.filter(open_)
        last = (left.agg(F.max("task")).first()[0] or 0) < GROUP
        found = merged(left, level * LEVEL, window, slack, last)
        found = found if last else checkpointed(found)
        out, level = out.union(found.filter(~open_).select(columns)), level + 1
    return out
