"""Arrow plumbing shared by the text operators: bounded slices of a batch, words, hashes, crc splits.

Nulls become empty strings, no text is shortened, and a slice holds about SLICE_BYTES of text or
one text, whichever is more, so a task's memory follows its longest text and not its partition.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
U64 = np.uint64
#: Odd multipliers of the 64-bit mixes.
M1, M2, M3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; the multiplications wrap."""
    x = (x ^ (x >> U64(30))) * M2
    x = (x ^ (x >> U64(27))) * M3
    return x ^ (x >> U64(31))


def remainder(column: str, modulus: int):
    """crc32 of a column's text, modulo; null counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES, kind: pa.DataType = pa.string()) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """(slice, its texts without nulls), each of about limit bytes of text; kind: string or binary."""
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pc.fill_null(batch.column(text).cast(kind), "" if kind == pa.string() else b"")
        ends = np.cumsum(pc.binary_length(whole).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, end - start), whole.slice(start, end - start)
            start = end


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, UTF-8 bytes) of a string array, offsets from 0."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, vocabulary): words are runs without space, tab, LF, VT, FF and CR; only A-Z are lowered."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets, flat = lists.offsets.to_numpy().astype(np.int64), lists.values
    flat = flat.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():
        offsets = np.concatenate(([0], np.cumsum(full)))[offsets]
        flat = flat.filter(pa.array(full))
    encoded = flat.dictionary_encode()
    return offsets, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def word_hashes(vocabulary: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary.to_pylist()), U64, len(vocabulary))


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each item."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def shingles(offsets: np.ndarray, hashes: np.ndarray, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every window of size words within a row. short: a row of fewer words gives its whole sequence."""
    lengths = np.diff(offsets)
    n = len(hashes)
    out = np.zeros(n, U64)
    for k in range(size):
        out[: n - k] = out[: n - k] * M1 + hashes[k:]
    row = rows_of(offsets)
    valid = np.arange(n) + size <= offsets[1:][row]
    row, out = row[valid], mix(out[valid])
    if short and (few := np.flatnonzero((lengths > 0) & (lengths < size))).size:
        own = []
        for i in few:
            h = np.array([size * 1000 + lengths[i]], U64)
            for x in hashes[offsets[i] : offsets[i + 1]]:
                h = h * M1 + x
            own.append(h)
        row, out = np.concatenate((row, few)), np.concatenate((out, mix(np.concatenate(own))))
    return row, out


def distinct_per_row(row: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): each row's distinct hashes, ascending within the row."""
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    row, hashes = row[keep], hashes[keep]
    return np.searchsorted(row, np.arange(n + 1)), hashes


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between offsets."""
    total = np.concatenate((np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=values.dtype if values.dtype.kind == "f" else np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def crc_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


@lru_cache(1)
def allocator():
    """The C library's function that returns freed memory to the system, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda keep: 0


def trim() -> None:
    """Gives back what arrays of the last slice took; workers live on and would keep it."""
    pa.default_memory_pool().release_unused()
    allocator()(0)


#: By module, what drops the things that its tasks left in this worker for its next ones.
LEFT: dict[str, Callable[[], None]] = {}


def clear_others(module: str) -> None:
    """Drops what tasks of other modules left in this worker, which lives on from stage to stage."""
    others = [m for m in LEFT if m != module]
    for other in others:
        LEFT.pop(other)()
    if others:
        trim()


def least_hashed(df: DataFrame, h: str, key: str, rows: int, of: int) -> DataFrame:
    """The rows rows of df with the least h, a 64-bit hash, or all of its of rows if they are no more.

    Only hashes below a bound that a few more than rows are expected to meet are sorted, so what
    tasks hand on does not grow with the number of partitions. Should too few meet it, those are
    the sample.
    """
    expected = rows + 8 * int(rows**0.5) + 20
    if of > expected:
        df = df.filter(F.col(h) < F.lit(int((expected / of - 0.5) * 2.0**64)).cast("long"))
    return df.orderBy(h, key).limit(rows)


def packed_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, and packed: the texts compressed one by one, which shuffle in about half the space; null as empty."""

    def make():
        compress = zstandard.ZstdCompressor(level=1).compress

        def run(batches):
            for part, texts in slices(batches, text):
                yield {key: part.column(key), "packed": [compress(t.encode()) for t in texts.to_pylist()]}

        return run

    return map_arrow(df.select(key, text), make, f"{key} {df.schema[key].dataType.simpleString()}, packed binary")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the column text in place of packed, a slice's bytes or one text at a time."""
    restore = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        at = batch.schema.get_field_index("packed")
        sizes = np.array([zstandard.frame_content_size(p) for p in batch.column(at).to_pylist()], np.int64)
        ends, low, high = np.cumsum(sizes), 0, 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SLICE_BYTES, "right")))
            part, low = batch.slice(low, high - low), high
            yield part.set_column(at, "text", pa.array([restore(p) for p in part.column(at).to_pylist()], pa.binary()).cast(pa.string()))


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores behind it until it is no column of df."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def map_arrow(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """df through make()(batches), which yields pyarrow batches or dicts of columns, in the schema's order."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_others(make.__module__)
        for out in make()(batches):
            arrays = [pa.array(out[f.name], f.type, from_pandas=isinstance(out[f.name], pd.Series)) if not isinstance(out[f.name], (pa.Array, pa.ChunkedArray)) else out[f.name].cast(f.type) for f in target]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)
            del out, arrays
            trim()

    return df.mapInArrow(run, schema)


def checkpoint_folder(df: DataFrame):
    """The context of df, with a checkpoint folder: the shared one that spark.checkpoint.dir names.

    Only where that is unset, as in local tests, a folder in the warehouse is set.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(shared or df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.checkpoints")
    return context


def shrunk(spark: SparkSession) -> None:
    """Has the executors collect their garbage, after which their heaps are as large as what they hold asks for.

    A heap that grew in one stage stays as large in the next ones, beside all that their workers take. As many tasks
    as executors are dealt one to each that is idle; where there are none but the driver, its own collection does it.
    """
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        tasks = max(1, len(context._jsc.sc().statusTracker().getExecutorInfos()) - 1)  # the driver is among them
        spark.range(0, tasks, 1, tasks).select(F.call_function("java_method", F.lit("java.lang.System"), F.lit("gc"))).collect()


def released(df: DataFrame) -> DataFrame:
    """df, after Spark's cleaner was let to drop the shuffle files of plans that no variable holds any more.

    For use after a checkpoint has cut off a large shuffle; the cleaner acts on what the driver's JVM has collected.
    The executors, whose heaps grew with that shuffle, are shrunk.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    shrunk(df.sparkSession)
    return df


#: A plan made under it has its shuffle files removed from all executors when it has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def own_shuffles(df: DataFrame) -> DataFrame:
    """df as a plan of its own, whose shuffle files go once it has run; for plans that run once."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return df.select("*")
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a copy in the shared checkpoint folder.

    What Spark returns holds on to the plan it came from, so the cleaner alone would keep that plan's
    shuffle files as long as the copy is in use.
    """
    checkpoint_folder(df)
    return own_shuffles(df).checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As checkpointed, but a Parquet table, which is much smaller for strings; removed when Python ends."""
    context = checkpoint_folder(df)
    path = f"{context._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    spark, jvm = df.sparkSession, context._jvm
    df.write.parquet(path)
    del df

    def remove() -> None:
        if context._jsc is not None and not context._jsc.sc().isStopped():
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)

    atexit.register(remove)
    return spark.read.parquet(path)
