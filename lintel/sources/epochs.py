"""A store of versioned entities and types: appended Parquet tables, consistent cuts, closures.

Rows are only ever added. A version's number is one more than the largest of its entity; an edge
is pinned to a version or, with null, floats, and then means the version that an epoch selects.
One writer at a time; readers need no coordination, as nothing they see changes.

A table's ids are a small part of their size as rows once they are compressed in files, by which Spark would choose
what it sends to the driver and on to all executors. So joins are shuffled, but for a side that a count shows to be small.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintel.engine import BROADCAST_ROWS

# The tables and their columns.
TABLES = {
    "types": "id string",
    "type_versions": "type_id string, version_id bigint, content binary, tag string, created_at timestamp",
    "type_edges": "from_id string, from_ver bigint, to_id string, to_ver bigint",
    "entities": "id string, type_id string",
    "entity_versions": "entity_id string, version_id bigint, content binary, type_id string, type_version_id bigint, created_at timestamp",
    "entity_edges": "from_id string, from_ver bigint, to_id string, to_ver bigint",
    "epochs": "epoch_id bigint, created_at timestamp",
    "epoch_entities": "epoch_id bigint, entity_id string, version_id bigint",
    "epoch_types": "epoch_id bigint, type_id string, version_id bigint",
}


class StoreError(Exception):
    pass


class NotFound(StoreError, LookupError):
    pass


class Conflict(StoreError):
    pass


class DanglingReference(StoreError):
    pass


class NotInEpoch(StoreError, LookupError):
    pass


@dataclass
class Closure:
    """Versions that a root reaches in an epoch; edges are resolved to versions."""

    entities: DataFrame  # entity_id, version_id
    types: DataFrame  # type_id, version_id
    edges: DataFrame  # from_id, from_ver, to_id, to_ver


def joined(left: DataFrame, right: DataFrame, on: str | list[str] | list[Column], how: str = "inner") -> DataFrame:
    """A join that shuffles both sides, whatever the size of their files."""
    return left.join(right.hint("merge"), on, how)


def beside(left: DataFrame, right: DataFrame, on: str | list[str] | list[Column], how: str = "inner", rows: int | None = None) -> DataFrame:
    """A join whose right side is broadcast if it has few rows; rows: its count, if known."""
    rows = right.count() if rows is None else rows
    return left.join(F.broadcast(right), on, how) if rows <= BROADCAST_ROWS else joined(left, right, on, how)


class EpochStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        for name, columns in TABLES.items():
            path, files = self.place(f"{self.root}/{name}")
            if not files.exists(path):
                spark.createDataFrame([], columns).write.parquet(f"{self.root}/{name}")

    def place(self, path: str):
        """A path as Hadoop has it, and its file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        rows.select(columns).write.mode("append").parquet(f"{self.root}/{name}")

    def rows(self, name: str, *rows: tuple) -> DataFrame:
        return self.spark.createDataFrame(list(rows), TABLES[name])

    # --- bulk writing

    def must_exist(self, rows: DataFrame, table: str, on: dict[str, str], what: str) -> None:
        """Every row's columns, unless one is null, name a row of a table."""
        there = self.table(table).select(*(F.col(c).alias(f"_{c}") for c in on.values()))
        condition = [F.col(a) == F.col(f"_{b}") for a, b in on.items()]
        known = rows.filter(" and ".join(f"{a} is not null" for a in on)).select(*on)
        if known.head() is None:
            return
        # each key once, so that one which many rows share is no task of its own
        if missing := joined(known.distinct(), there, condition, "left_anti").head():
            raise DanglingReference(f"{what}: {missing.asDict()}")

    def next_versions(self, rows: DataFrame, key: str, table: str) -> DataFrame:
        """rows with version_id: on from the largest of their key, in the order of their content where a key comes twice."""
        last = self.table(table).groupBy(key).agg(F.max("version_id").alias("_last"))
        place = F.row_number().over(Window.partitionBy(key).orderBy("content"))
        return joined(rows, last, key, "left").withColumn("version_id", F.coalesce("_last", F.lit(0)) + place).drop("_last")

    def create_types(self, ids: Iterable[str]) -> None:
        """Types that are there already stay as they are."""
        new = self.rows("types", *((i,) for i in ids)).distinct()
        self.append("types", joined(new, self.table("types"), "id", "left_anti"))

    def put_type_versions(self, rows: DataFrame) -> DataFrame:
        """rows: type_id, content, tag. Returns type_id, version_id."""
        self.must_exist(rows, "types", {"type_id": "id"}, "no such type")
        new = self.next_versions(rows, "type_id", "type_versions").withColumn("created_at", F.current_timestamp())
        return self.added("type_versions", self.copied(new, self.aside()), ["type_id", "version_id"])

    def create_entities(self, rows: DataFrame) -> None:
        """rows: id, type_id. An entity that is there keeps its type; another one is a conflict."""
        each = rows.distinct().withColumn("_types", F.count(F.lit(1)).over(Window.partitionBy("id")))
        there = self.table("entities").select("id", F.col("type_id").alias("_type"))
        with self.staged(joined(each, there, "id", "left")) as every:
            self.must_exist(every, "types", {"type_id": "id"}, "no such type")
            if clash := every.filter("_type <> type_id or _types > 1").select("id").head():
                raise Conflict(f"{clash[0]} has another type")
            self.append("entities", every.filter("_type is null"))

    def put_versions(self, rows: DataFrame) -> DataFrame:
        """rows: entity_id, content, type_version_id (null: the type's latest). Returns entity_id, version_id."""
        entities = self.table("entities").select(F.col("id").alias("entity_id"), "type_id", F.lit(True).alias("_there"))
        new = joined(rows.filter("entity_id is not null"), entities, "entity_id", "left")
        new = self.next_versions(new, "entity_id", "entity_versions").withColumn("created_at", F.current_timestamp())
        latest = self.table("type_versions").groupBy("type_id").agg(F.max("version_id").alias("_latest"))
        new = beside(new, latest, "type_id", "left").withColumn("type_version_id", F.coalesce("type_version_id", "_latest")).drop("_latest")
        new = self.copied(new, self.aside())
        if missing := new.filter("_there is null").select("entity_id").head():
            raise DanglingReference(f"no such entity: {missing.asDict()}")
        if new.filter("type_version_id is null").head():
            raise NotFound("the type has no version yet")
        self.must_exist(new, "type_versions", {"type_id": "type_id", "type_version_id": "version_id"}, "no such type version")
        return self.added("entity_versions", new, ["entity_id", "version_id"])

    def aside(self) -> str:
        """A new place where readers do not look."""
        return f"{self.root}/_staged-{uuid.uuid4().hex}"

    def copied(self, rows: DataFrame, path: str) -> DataFrame:
        """rows by a copy, so that checks and the append do not work them out again."""
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    @contextmanager
    def staged(self, rows: DataFrame) -> Iterator[DataFrame]:
        """rows by a copy that goes at the end."""
        name = self.aside()
        try:
            yield self.copied(rows, name)
        finally:
            path, files = self.place(name)
            files.delete(path, True)

    def added(self, table: str, rows: DataFrame, columns: list[str]) -> DataFrame:
        """Appends copied rows and returns some of their columns."""
        self.append(table, rows)
        out = rows.select(columns)
        keys = [tuple(r) for r in out.take(1)]
        out.first_row = keys[0] if keys else None
        return out

    def add_edges(self, kind: str, rows: DataFrame) -> None:
        """kind: type or entity; rows: from_id, from_ver, to_id, to_ver (null: floating)."""
        header, versions, key = ("types", "type_versions", "type_id") if kind == "type" else ("entities", "entity_versions", "entity_id")
        with self.staged(rows) as edges:
            self.must_exist(edges, versions, {"from_id": key, "from_ver": "version_id"}, "no such version")
            self.must_exist(edges, header, {"to_id": "id"}, f"no such {kind}")
            self.must_exist(edges, versions, {"to_id": key, "to_ver": "version_id"}, "no such version")
            self.append(f"{kind}_edges", edges)

    # --- one at a time

    def create_type(self, id: str) -> None:
        self.create_types([id])

    def put_type_version(self, id: str, content: bytes, tag: str = "") -> int:
        return self.put_type_versions(self.spark.createDataFrame([(id, content, tag)], "type_id string, content binary, tag string")).first_row[1]

    def add_type_edge(self, from_id: str, from_ver: int, to_id: str, to_ver: int | None = None) -> None:
        self.add_edges("type", self.rows("type_edges", (from_id, from_ver, to_id, to_ver)))

    def create_entity(self, id: str, type_id: str) -> None:
        self.create_entities(self.rows("entities", (id, type_id)))

    def put_version(self, id: str, content: bytes, type_version: int | None = None) -> int:
        return self.put_versions(self.spark.createDataFrame([(id, content, type_version)], "entity_id string, content binary, type_version_id bigint")).first_row[1]

    def add_edge(self, from_id: str, from_ver: int, to_id: str, to_ver: int | None = None) -> None:
        self.add_edges("entity", self.rows("entity_edges", (from_id, from_ver, to_id, to_ver)))

    # --- reading

    def version(self, kind: str, id: str, version: int | None = None):
        """A version's row, the latest if none is named."""
        key = f"{kind}_id"
        rows = self.table(f"{kind}_versions").filter(F.col(key) == id)
        row = rows.filter(F.col("version_id") == version).head() if version is not None else rows.orderBy(F.desc("version_id")).head()
        if row is None:
            raise NotFound(f"{kind} {id} has no version {version or ''}".strip())
        return row

    def latest(self, kind: str) -> DataFrame:
        """id column, version_id: the largest of each."""
        return self.table(f"{kind}_versions").groupBy(f"{kind}_id").agg(F.max("version_id").alias("version_id"))

    def cut_epoch(self) -> int:
        """A new epoch that selects the latest version of everything. Its own row comes last and makes it visible."""
        epoch = (self.table("epochs").agg(F.max("epoch_id")).first()[0] or 0) + 1
        for kind, table in (("entity", "epoch_entities"), ("type", "epoch_types")):
            self.append(table, self.latest(kind).withColumn("epoch_id", F.lit(epoch).cast("long")))
        self.append("epochs", self.spark.range(1).select(F.lit(epoch).cast("long").alias("epoch_id"), F.current_timestamp().alias("created_at")))
        return epoch

    def selected(self, epoch: int, kind: str) -> DataFrame:
        if self.table("epochs").filter(F.col("epoch_id") == epoch).head() is None:
            raise NotFound(f"no epoch {epoch}")
        return self.table("epoch_entities" if kind == "entity" else "epoch_types").filter(F.col("epoch_id") == epoch).select(F.col(f"{kind}_id").alias("id"), F.col("version_id").alias("ver"))

    def edges_from(self, nodes: DataFrame, kind: str, rows: int) -> DataFrame:
        """The edges of nodes, which are id, ver and so many rows."""
        return beside(self.table(f"{kind}_edges"), nodes, [F.col("from_id") == F.col("id"), F.col("from_ver") == F.col("ver")], rows=rows).drop("id", "ver")

    def resolved(self, edges: DataFrame, chosen: DataFrame) -> DataFrame:
        """edges, floating ends set to what an epoch selects; null where it selects nothing."""
        return joined(edges, chosen.withColumnRenamed("id", "to_id"), "to_id", "left").withColumn("to_ver", F.coalesce("to_ver", "ver")).drop("ver")

    def reach(self, seeds: DataFrame, epoch: int, kind: str) -> tuple[DataFrame, int]:
        """id, ver: everything that the seeds reach, and its rows; a frontier is joined to the edges until it brings nothing new."""

        def counted(found: DataFrame) -> tuple[DataFrame, int]:
            found = self.cut(found)
            rows, there = found.agg(F.count(F.lit(1)), F.count("ver")).first()
            if there < rows:
                raise NotInEpoch(f"{found.filter('ver is null').head()['id']} is not in epoch {epoch}")
            return found, rows

        chosen = self.selected(epoch, kind)
        frontier, rows = counted(seeds.distinct())
        seen, total = frontier, rows
        while rows:
            # ends that many edges share are resolved once
            ends = self.edges_from(frontier, kind, rows).select("to_id", "to_ver").distinct()
            ahead = self.resolved(ends, chosen).select(F.col("to_id").alias("id"), F.col("to_ver").alias("ver")).distinct()
            frontier, rows = counted(beside(ahead, seen, ["id", "ver"], "left_anti", rows=total))
            if rows:
                seen, total = self.cut(seen.union(frontier)), total + rows
        return seen, total

    def cut(self, df: DataFrame) -> DataFrame:
        """df without its lineage, by a copy in the shared checkpoint folder."""
        context = self.spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(self.spark.conf.get("spark.checkpoint.dir", None) or f"{self.root}/_checkpoints")
        return df.checkpoint()

    def closure(self, epoch: int, roots: str | Iterable[str] | DataFrame) -> Closure:
        """What the roots reach: entities by their edges, then the types they pin and those types' edges.

        roots: an id, some ids, or any number of them as the first column of a DataFrame.
        """
        if isinstance(roots, DataFrame):
            asked = roots.select(F.col(roots.columns[0]).alias("id")).distinct()
        else:
            asked = self.spark.createDataFrame([(i,) for i in ([roots] if isinstance(roots, str) else roots)], "id string")
        chosen = self.selected(epoch, "entity")
        entities, rows = self.reach(joined(asked, chosen, "id", "left"), epoch, "entity")
        pinned = beside(self.table("entity_versions"), entities, [F.col("id") == F.col("entity_id"), F.col("ver") == F.col("version_id")], rows=rows)
        types, _ = self.reach(pinned.select(F.col("type_id").alias("id"), F.col("type_version_id").alias("ver")), epoch, "type")
        inside = self.resolved(self.edges_from(entities, "entity", rows), chosen).select("from_id", "from_ver", "to_id", "to_ver")
        return Closure(entities.select(F.col("id").alias("entity_id"), F.col("ver").alias("version_id")), types.select(F.col("id").alias("type_id"), F.col("ver").alias("version_id")), inside)
