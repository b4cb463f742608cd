"""Expressions run on Spark: values, nulls, errors, NaN; against SQL and against an interpreter."""

import math
import os
import random

import duckdb
import pytest
from lintel.engine import Engine
from lintel.functions.lower import LowerError
from lintel.functions.udf import Function, Registry, UdfError
from lintel.operators.aggregates import Aggregate, aggregate
from lintel.plans import queries as plans
from lintel.plans.passes import Import
from lintel.plans.typecheck import TypeCheckError
from lintel.types import I64, STRING, Field
from pyspark.sql import functions as F

from .conftest import DATA


@pytest.fixture(scope="module")
def rows(spark):
    data = [(10, 0, 2.5, "a.b@x.com", [1, 5, 0], "https://h.io/a/b?a=1&b=2%20x+y&c="), (-7, 2, float("nan"), "zz", [], "/foo/bar.php?baz=quux"), (7, None, None, None, None, None), (2**62, 3, 0.0, "", [2, None], "mailto:x")]
    return spark.createDataFrame(data, "a long, b long, d double, s string, xs array<long>, u string").withColumn("t", F.expr("timestamp_ntz'2024-03-05 13:14:37.25'")).cache()


def values(rows, text, on_error="null", engine=None):
    return [r[0] for r in (engine or Engine()).select(rows, on_error, v=text).collect()]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("a / b", [None, -3, None, 2**62 // 3]),
        ("try_or_else(a / b, -1)", [-1, -3, None, 2**62 // 3]),
        ("try_or_else(a * 4, 0)", [40, -28, 28, 0]),
        ("a % 3", [1, -1, 1, 1]),
        ("10 / b > 1 && a > 20", [False, False, False, True]),
        ("10 / b > 1 || a > 8", [True, True, None, True]),
        ("false && a / 0 == 1", [False] * 4),
        ("d == d", [True, False, None, True]),
        ("d != d", [False, True, None, False]),
        ("d < 1.0", [False, False, None, True]),
        ("d / 0.0", [math.inf, "nan", None, "nan"]),
        ("least(a, b)", [0, -7, None, 3]),
        ("regex_extract(s, '(a)[.](b)')", ["a", None, None, None]),
        ("regex_extract(s, 'z')", [None, "z", None, None]),
        ("url_path_segment(u, 1)", ["b", "bar.php", None, None]),
        ("url_path_segment(u, 0, 'require_scheme')", ["a", None, None, None]),
        ("url_path_segment(u, -1)", [None] * 4),
        ("url_query_param(u, 'b')", ["2 x y", None, None, None]),
        ("url_query_param(u, 'c')", ["", None, None, None]),
        ("url_query_param(u, 'baz', null)", [None, "quux", None, None]),
        ("xs.all(x, 10 / x > 3)", [False, True, None, None]),
        ("xs.exists(x, 10 / x > 1)", [True, False, None, True]),
        ("xs.exists_one(x, x == 5)", [True, False, None, False]),
        ("xs[1]", [5, None, None, None]),
        ("try_or_else(xs[9], 99)", [99, 99, None, 99]),
        ("try_or_else(xs[1], 99)", [5, 99, None, None]),
        ("t.getMonth()", [2] * 4),
        ("t.getDayOfWeek()", [2] * 4),
        ("t.getMilliseconds()", [250] * 4),
        ("coalesce(b, a / 0)", [0, 2, None, 3]),
        ("b == 0 ? 1 : a / b", [1, -3, None, 2**62 // 3]),
        ("case(a > 8, 'big', a > 0, 'mid', 'neg')", ["big", "neg", "mid", "big"]),
        ("int(s)", [None] * 4),
        ("uint(a)", [10, None, 7, 2**62]),
        ("string_split(s, '.')", [["a", "b@x", "com"], ["zz"], None, [""]]),
        ("json_stringify(s)", ['"a.b@x.com"', '"zz"', None, '""']),
        ("raise_error('no')", [None] * 4),
        ("try_or_else(raise_error('no'), a)", [10, -7, 7, 2**62]),
        ("duration('5m30s') == duration('330s')", [True] * 4),
        ("int_to_ip(ip_to_int('192.168.1.1'))", ["192.168.1.1"] * 4),
        ("cidr_contains('::ffff:10.1.2.3', '10/8')", [True] * 4),
        ("cidr_contains('fe80::1', 'fe80::/10')", [True] * 4),
        ("cidr_contains('ff00::1', 'fe80::/10')", [False] * 4),
        ("cidr_contains('10.0.0.1', '10.0.0.0/33')", [None] * 4),
        ("cidr_match('172.16.5.5', ['172.16.0/12', '10.0.0.1/32'])", [True] * 4),
    ],
)
def test_values(rows, text, expected):
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    assert [plain(v) for v in values(rows, text)] == expected


def test_errors_fail_the_query_unless_told_otherwise(rows):
    with pytest.raises(Exception, match="failed"):
        values(rows, "a / b", "raise")
    assert Engine().filter(rows, "10 / b > 3", "false").count() == 1
    with pytest.raises(LowerError):
        values(rows, "a / b", "false")
    for text in ("s.matches('(?=a)')", r"s.matches('(a)\\1')", "regex_replace(s, '(a)', '$1b')"):
        with pytest.raises(LowerError):
            values(rows, text)
    with pytest.raises(TypeError):
        Engine().filter(rows, "a + 1")


def test_plain_conditions_are_pushed_down(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = Engine().filter(spark.read.parquet(f"{DATA}/events.parquet"), "value >= 18 && event_type.endsWith('p')")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(value,18.0)" in plan and "StringEndsWith(event_type,p)" in plan and "Python" not in plan


# --- against an interpreter that shares nothing with the lowering

FAILED = object()


def interpret(tree, row):
    """Value, None, or FAILED of a tree of (op, ..)."""
    op, *args = tree
    if op == "field":
        return row[args[0]]
    if op == "lit":
        return args[0]
    if op in ("&&", "||"):
        a, b = interpret(args[0], row), interpret(args[1], row)
        decides = op == "||"
        if a is decides or b is decides:
            return decides
        return FAILED if FAILED in (a, b) else None if None in (a, b) else not decides
    if op == "try":
        a = interpret(args[0], row)
        return interpret(args[1], row) if a is FAILED else a
    if op == "?":
        c = interpret(args[0], row)
        return FAILED if c is FAILED else interpret(args[1] if c else args[2], row)
    if op == "coalesce":
        a = interpret(args[0], row)
        return interpret(args[1], row) if a is None else a
    a, b = (interpret(x, row) for x in args)
    if FAILED in (a, b):
        return FAILED
    if a is None or b is None:
        return None
    if op in ("/", "%"):
        if b == 0:
            return FAILED
        q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        out = q if op == "/" else a - b * q
    else:
        out = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "<": lambda: a < b, "==": lambda: a == b}[op]()
    return FAILED if not isinstance(out, bool) and not -(2**63) <= out < 2**63 else out


def text_of(tree):
    op, *args = tree
    if op == "field":
        return args[0]
    if op == "lit":
        return {True: "true", False: "false"}.get(args[0]) if isinstance(args[0], bool) else f"({args[0]})"
    if op in ("try", "coalesce"):
        return f"{'try_or_else' if op == 'try' else op}({text_of(args[0])}, {text_of(args[1])})"
    if op == "?":
        return "({} ? {} : {})".format(*map(text_of, args))
    return f"({text_of(args[0])} {op} {text_of(args[1])})"


def grow(rng, kind, depth):
    if depth == 0 or rng.random() < 0.15:
        return ("lit", rng.choice([True, False])) if kind == "bool" and rng.random() < 0.5 else ("<", grow(rng, "int", 0), grow(rng, "int", 0)) if kind == "bool" else rng.choice([("field", "a"), ("field", "b"), ("lit", rng.choice([0, 1, 2, -3, 2**61]))])
    inner = lambda k: grow(rng, k, depth - 1)
    op = rng.choice(["&&", "||", "<", "==", "try", "?", "coalesce"] if kind == "bool" else ["+", "-", "*", "/", "%", "try", "?", "coalesce"])
    if op == "?":
        return (op, inner("bool"), inner(kind), inner(kind))
    return (op, inner("int" if op in ("<", "==") else kind), inner("int" if op in ("<", "==") else kind))


def test_random_trees_against_an_interpreter(spark):
    rng, data = random.Random(11), [(a, b) for a in (0, 5, -7, None, 2**62) for b in (0, 2, -1, None)]
    df, engine = spark.createDataFrame(data, "a long, b long").coalesce(1), Engine()
    trees = [grow(rng, rng.choice(["int", "bool"]), 3) for _ in range(60)]
    out = engine.select(df, "null", **{f"v{i}": text_of(t) for i, t in enumerate(trees)}).collect()
    for i, t in enumerate(trees):
        for row, (a, b) in zip(out, data, strict=True):
            expected = interpret(t, {"a": a, "b": b})
            assert row[f"v{i}"] == (None if expected is FAILED else expected), (text_of(t), a, b)


# --- against SQL


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else repr(v)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_against_sql(spark, sql, name):
    found = plans.queries()[name](spark, DATA)
    expected = sql.sql(plans.oracle_sql()[name])
    assert sorted(found.columns) == sorted(expected.columns)
    ours = sorted(str([plain(r[c]) for c in sorted(found.columns)]) for r in found.collect())
    order = sorted(range(len(expected.columns)), key=lambda i: expected.columns[i])
    assert ours == sorted(str([plain(r[i]) for i in order]) for r in expected.fetchall())


# --- functions from outside


def test_functions_guard_nulls(rows):
    registry = Registry()
    add = lambda name, params, body, **k: registry.add(Function("ns", "1", name, name, params, STRING, body=body, **k))
    add("strict", (Field("s", STRING),), lambda s: s + "!")
    add("loose", (Field("s", STRING, True),), lambda s: "none" if s is None else s)
    engine = Engine(registry, [Import("ns", "1", "strict"), Import("ns", "1", "loose")])
    assert values(rows, "strict(s)", engine=engine) == ["a.b@x.com!", "zz!", None, "!"]
    assert values(rows, "loose(s)", engine=engine) == ["a.b@x.com", "zz", "none", ""]
    assert values(rows, "loose()", engine=engine) == ["none"] * 4
    with pytest.raises(UdfError):
        add("strict", (), None)
    with pytest.raises(UdfError):
        registry.load("namespace: a\nfunctions: []")
    registry.load("namespace: a\nversion: '1'\nfunctions: [{ id: f, params: [{ name: x, type: i64 }], return_type: i64 }]")
    with pytest.raises(UdfError):
        values(rows, "f(a)", engine=Engine(registry, [Import("a", "1", "f")]))
    registry.implement(("a", "1", "f"), lambda x: x % 5)
    assert values(rows, "f(a)", engine=Engine(registry, [Import("a", "1", "f")])) == [0, 3, 2, 2**62 % 5]
    assert registry.functions[("a", "1", "f")].params[0].type == I64


# --- aggregates


def test_aggregates_are_checked(rows):
    for make in (lambda: Aggregate("nope", "a"), lambda: Aggregate("sum"), lambda: Aggregate("first", "a"), lambda: Aggregate("percentile", "a"), lambda: Aggregate("max", "a", by="b")):
        with pytest.raises(TypeCheckError):
            make()
    with pytest.raises(TypeCheckError):
        aggregate(Engine(), rows, x=Aggregate("sum", "s"))
    out = aggregate(Engine(), rows, n=Aggregate("count"), b=Aggregate("count", "b"), least=Aggregate("min", "a"), around=Aggregate("count_distinct", "a", approximate=0.05), mid=Aggregate("percentile", "b", at=0.5, approximate=0.01)).first()
    assert (out.n, out.b, out.least, out.around, out.mid) == (4, 3, -7, 4, 2)
    places = aggregate(Engine(), rows, second=Aggregate("nth_value", "a", "a", 2), ninth=Aggregate("nth_value", "a", "a", 9), n=Aggregate("count")).first()
    assert (places.second, places.ninth, places.n) == (7, None, 4)
    only = aggregate(Engine(), rows, {"b": "b"}, first_=Aggregate("nth_value", "a", "a", 1)).collect()
    assert {r.b: r.first_ for r in only} == {0: 10, 2: -7, None: 7, 3: 2**62}
    empty = aggregate(Engine(), rows.limit(0), n=Aggregate("count"), total=Aggregate("sum", "a")).first()
    assert (empty.n, empty.total) == (0, None)


@pytest.mark.parametrize(
    ("address", "block", "expected"),
    [
        ("fe80::1", "fe80::/10", True), ("ff00::1", "fe80::/10", False), ("::ffff:10.1.2.3", "10/8", True), ("::ffff:a01:203", "10.0.0.0/8", True), ("10.1.2.3", "::ffff:0:0/96", True), ("10.1.2.3", "::/0", True), ("11.1.2.3", "10/8", False),
        ("1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8/128", True), ("1:2:3:4:5:6:7::", "1:2::/32", True), ("1:2:3:4:5:6:7:8:9", "::/0", None), ("::1::2", "::/0", None), (":1", "::/0", None), ("12345::", "::/0", None), ("1.2.3", "0/0", None), ("::1.2.3.256", "::/0", None), ("::", "::/0", True), (None, "::/0", None), ("::1", "10.0.0.0/33", None), ("::1", "::/129", None),
    ],
)
def test_addresses_in_blocks_without_python(spark, address, block, expected):
    from lintel.functions import net

    df = spark.createDataFrame([(address, block)], "a string, b string").select(net.in_block(F.col("a"), block).alias("x"), net.in_block_of(F.col("a"), F.col("b")).alias("y"), net.in_any(F.col("a"), ["fe80::/64", block]).alias("z"))
    assert tuple(df.first()) == (expected, expected, None if address is None else bool(expected))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_window_functions_refuse_what_they_cannot(spark):
    from lintel.operators.windows import Over, over

    for args in (("median",), ("lag",), ("rank", "x"), ("ntile", None, 0)):
        with pytest.raises(TypeCheckError):
            Over(*args)
    with pytest.raises(TypeCheckError):
        over(Engine(), spark.range(1), [], [], r=Over("rank"))


def test_a_url_is_taken_apart_once_for_all_expressions(spark):
    df = spark.createDataFrame([("https://h/a/%2E/b?x=1&y=2#z",), ("/c?y=3",), (None,)], "u string").coalesce(1)
    exprs = {"a": "url_path_segment(u, 0)", "b": "url_path_segment(u, 1, 'require_authority')", "x": "url_query_param(u, 'x')", "y": "url_query_param(u, 'y')", "inner": "[u].map(v, url_path_segment(v, 0))[0]"}
    out = Engine().select(df, "null", ["u"], **exprs)
    assert [tuple(r)[1:] for r in out.collect()] == [("a", "b", "1", "2", "a"), ("c", None, None, "3", "c"), (None,) * 5]
    assert out.columns == ["u", *exprs]
    del exprs["inner"]  # the one of an element is no row's
    plan = Engine().select(df, **exprs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[A-Za-z][A-Za-z0-9+") == 1
