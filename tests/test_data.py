"""Validation, events, the store of versions, and streams."""

import json

import pytest
from lintel.engine import Engine
from lintel.operators.aggregates import Aggregate
from lintel.operators.validation import Rule, RuleError, Rules, checked, effects, first_mismatch, path, shown, split
from lintel.plans.queries import epochs, read
from lintel.sources.epochs import Conflict, DanglingReference, EpochStore, NotFound, NotInEpoch
from lintel.sources.events import proto, read_events
from lintel.streaming.windows import joined_streams, trigger_ms, windowed
from lintel.types import TypeBook
from pyspark.sql import functions as F

from .conftest import DATA


def found(df, t=None, rules=None):
    return [[(v.tier, v.path, v.rule) for v in r.violations] for r in checked(df, t, rules).collect()]


def test_paths():
    assert path("addr.lines[0]") == ("addr", "lines", 0) and shown(("addr", "lines", 0)) == "addr.lines[0]" and shown(()) == "(root)" and path("(root)") == ()


def test_structure(spark):
    t = TypeBook().parse("{ struct: [ { name: name, type: string }, { name: age, type: u8, nullable: true }, { name: tags, type: { array: { element: string } } }, { name: kind, type: { enum: [a, b] } }, { name: more, type: { map: { key: string, value: i64 } } }, { name: id, type: uuid, nullable: true } ] }")
    good = "0" * 8 + "-0000-0000-0000-" + "0" * 12
    rows = [("x", 1, ["p"], "a", {"k": 1}, good, 5), (None, 300, ["p", None], "c", {"k": None}, "no", 5), ("y", None, None, "b", {}, None, None)]
    df = spark.createDataFrame(rows, "name string, age int, tags array<string>, kind string, more map<string,long>, id string, extra int").coalesce(1)
    assert found(df, t) == [[], [("conformance", p, "type") for p in ("name", "age", "tags[1]", "kind", "more[0]", "id")], [("conformance", "tags", "type")]]
    assert found(df.drop("name"), t)[0] == [("conformance", "name", "type")]
    assert found(df.withColumn("age", F.lit("old")), t)[2] == [("conformance", "age", "type"), ("conformance", "tags", "type")]
    out = checked(df, t).select(first_mismatch(F.col("violations")).alias("m"), effects(F.col("violations")).alias("e")).collect()
    assert out[0].m is None and out[0].e == [] and out[1].m.startswith("type at name: null") and out[1].e == ["may_not_conform"]
    by_place = df.withColumn("kind", F.lit(2))
    assert all(("conformance", "kind", "type") in v for v in found(by_place, t))


def test_rules(spark):
    df = spark.createDataFrame([("abc", 17, 0.0, 2**53 + 1, (5, 3)), ("Ab1", 70, float("nan"), 2**53, (1, 3)), ("", None, 1.0, 0, None)], "name string, age long, x double, n long, span struct<lo:long,hi:long>").coalesce(1)
    of = lambda **fields: found(df, None, Rules.of({k.replace("__", "."): v for k, v in fields.items()}))
    broken = lambda out: [bool(v) for v in out]
    assert broken(of(age=[Rule("min", 18), Rule("max", 65)])) == [True, True, False]
    assert broken(of(x=[Rule("min", 0.0)])) == [False, False, False] and broken(of(x=[Rule("min", 0.0, inclusive=False)])) == [True, False, False]
    assert broken(of(n=[Rule("max", 2**53)])) == [True, False, False]
    assert broken(of(name=[Rule("non_empty"), Rule("pattern", "[a-z]*")])) == [False, True, True]
    assert broken(of(name=[Rule("pattern", "b", search=True)])) == [False, False, True]
    assert broken(of(name=[Rule("min_len", 1), Rule("max_len", 2)])) == [True, True, True]
    assert broken(of(age=[Rule("one_of", [17, 18])])) == [False, True, False] and broken(of(nope=[Rule("min", 1)])) == [False] * 3
    assert broken(of(span__lo=[Rule("max", 3)])) == [True, False, False]
    both = Rules.of(entity=[Rule("expr", "lo < hi")]).prefixed("span") & Rules.of({"age": [Rule("expr", "this > 18")]})
    assert [[p for _, p, _ in v] for v in found(df, None, both)] == [["span", "age"], [], []]
    for rules in (Rules.of({"name": [Rule("expr", "1 + 1")]}), Rules.of({"span": [Rule("min", 1)]}), Rules.of({"age": [Rule("min_len", 1)]})):
        with pytest.raises(RuleError):
            checked(df, None, rules)


def test_split_loses_no_row(spark):
    df = spark.read.parquet(f"{DATA}/events.parquet").withColumn("user_id", F.when(F.col("event_id") % 3 != 0, F.col("user_id")))
    parts = split(df, TypeBook().parse("{ struct: [ { name: user_id, type: i64 } ] }"), Rules.of({"value": [Rule("max", 10.0)]}))
    counts = [p.count() for p in (parts.accepted, parts.rejected, parts.quarantined)]
    assert sum(counts) == df.count() and all(counts) and parts.accepted.columns == df.columns
    assert split(df.limit(0)).accepted.count() == 0


ORDER = "{ struct: [ { name: ts, type: i64 }, { name: price, type: i64 }, { name: status, type: string }, { name: raw, type: uuid } ] }"


def test_declarations():
    t = TypeBook().parse(ORDER)
    text = proto(t, "OrderEvent", "example.event.v1")
    assert text.startswith('syntax = "proto3";') and "package example.event.v1;" in text and "sint64 price = 2;" in text and "bytes raw = 4;" in text
    assert "string status = 3;" in proto(t, "S", "p", ["status"]) and "price" not in proto(t, "S", "p", ["status"])


def test_events(spark):
    texts = [json.dumps({"ts": 1, "price": 2, "status": "a", "other": 1}), '{"ts": "x"}', "{oops", None, "[1]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, j string").coalesce(1)
    strict = read_events(df, "j", TypeBook().parse(ORDER)).collect()
    assert (strict[0].price, strict[0].status, strict[1].price, strict[2].malformed, strict[3].malformed, strict[4].malformed) == (2, "a", None, True, False, True)
    filled = read_events(df, "j", TypeBook().parse(ORDER), defaults=True, keep=["price", "status"]).collect()
    assert filled[1].price == 0 and filled[1].status == "" and filled[2].price is None and "ts" not in filled[0].asDict()


def test_store(spark, tmp_path):
    store = EpochStore(spark, str(tmp_path / "store"))
    for t in ("address", "order", "customer"):
        store.create_type(t)
        assert store.put_type_version(t, b"1") == 1
    store.add_type_edge("order", 1, "address", 1)
    store.add_type_edge("order", 1, "customer")
    store.create_entity("order-4711", "order")
    store.create_entity("cust-1", "customer")
    store.create_entity("cust-1", "customer")
    assert store.put_version("order-4711", b"o") == 1 and store.put_version("cust-1", b"c") == 1
    store.add_edge("order-4711", 1, "cust-1")
    store.add_edge("cust-1", 1, "order-4711", 1)  # a circle
    first = store.cut_epoch()
    assert store.put_version("cust-1", b"d") == 2 and store.put_type_version("customer", b"2") == 2
    closure = store.closure(first, "order-4711")
    assert sorted(map(tuple, closure.entities.collect())) == [("cust-1", 1), ("order-4711", 1)]
    assert sorted(map(tuple, closure.types.collect())) == [("address", 1), ("customer", 1), ("order", 1)]
    second = store.cut_epoch()
    assert second == 2 and ("cust-1", 2) in map(tuple, store.closure(second, "order-4711").entities.collect())
    assert sorted(map(tuple, store.closure(first, "order-4711").entities.collect())) == [("cust-1", 1), ("order-4711", 1)]
    roots = spark.createDataFrame([("order-4711",), ("order-4711",), ("cust-1",)], "some string")
    assert sorted(map(tuple, store.closure(first, roots).entities.collect())) == [("cust-1", 1), ("order-4711", 1)]
    assert store.version("entity", "cust-1").content == b"d" and store.version("entity", "cust-1", 1).content == b"c"
    assert store.version("entity", "cust-1", 2).type_version_id == 1
    with pytest.raises(Conflict):
        store.create_entity("cust-1", "order")
    for fails in (lambda: store.put_version("cust-1", b"", 99), lambda: store.create_entity("x", "nope"), lambda: store.add_edge("cust-1", 9, "cust-1"), lambda: store.add_edge("cust-1", 1, "nope"), lambda: store.put_type_version("nope", b"")):
        with pytest.raises(DanglingReference):
            fails()
    store.create_entity("new", "customer")
    with pytest.raises(NotInEpoch):
        store.closure(first, "new")
    for fails in (lambda: store.closure(9, "cust-1"), lambda: store.version("entity", "new")):
        with pytest.raises(NotFound):
            fails()


def test_store_sends_no_table_to_the_driver_by_the_size_of_its_files(spark, monkeypatch):
    monkeypatch.setattr("lintel.sources.epochs.BROADCAST_ROWS", -1, raising=False)

    def ran():
        found = spark._jsparkSession.sharedState().statusStore().executionsList()
        return {(x := found.apply(i)).executionId(): x.physicalPlanDescription() for i in range(found.size())}

    before = ran()
    rows = epochs(spark, DATA).count()
    orders = read(spark, DATA, "orders")
    assert rows == orders.count() + orders.select("o_custkey").distinct().count()
    plans = [p for i, p in ran().items() if i not in before]
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastExchange" in p for p in plans)


def test_triggers():
    engine = Engine()
    assert trigger_ms(engine, ["a > 1"]) is None
    assert trigger_ms(engine, ["round_temporal(current_timestamp(), 'hour') > ts", "round_temporal(current_timestamp(), '5 minutes') > ts"]) == 300_000
    assert trigger_ms(engine, ["current_timestamp() > ts"]) == 1000


@pytest.fixture()
def stream(spark, tmp_path):
    spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(str(tmp_path / "in"))
    rows = spark.read.parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))


def run(spark, df, mode):
    query = df.writeStream.format("memory").queryName("out").outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return sorted(map(tuple, spark.sql("select * from out").collect()))


def test_streams_give_what_tables_give(spark, stream):
    rows, live = stream
    engine = Engine()
    condition = "value > 5.0 && event_type in ['click', 'view']"
    assert run(spark, engine.filter(live, condition), "append") == sorted(map(tuple, engine.filter(rows, condition).collect()))
    make = lambda df: windowed(engine, df, "ts", "1 hour", {"n": Aggregate("count"), "top": Aggregate("max", "value")}, {"kind": "event_type"})
    assert run(spark, make(live), "complete") == sorted(map(tuple, make(rows).collect()))


def test_late_windows_are_held_until_they_are_complete(spark, stream):
    rows, live = stream
    make = lambda df: windowed(Engine(), df, "ts", "1 hour", {"n": Aggregate("count")}, late="10 minutes")
    whole, done = set(map(tuple, make(rows).collect())), run(spark, make(live), "append")
    assert set(done) <= whole and len(whole) - len(done) <= 3


def test_streams_are_joined_in_time(spark, stream):
    rows, live = stream
    a, b = live.select("user_id", "ts", "value"), live.select("user_id", F.col("ts").alias("ts2"), F.col("event_id"))
    found = run(spark, joined_streams(a, b, ["user_id"], "ts", "ts2", "1 minute", "1 hour"), "append")
    expected = rows.alias("a").join(rows.alias("b"), F.expr("a.user_id = b.user_id and b.ts between a.ts - interval 1 minute and a.ts + interval 1 minute")).count()
    assert len(found) == expected
