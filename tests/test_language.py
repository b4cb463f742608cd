"""Reading, writing, typing and rewriting expressions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lintel.functions.catalog import CATALOG, COMPREHENSIONS
from lintel.functions.cel import CelError, Raised, parse, write
from lintel.functions.lower import BY_OP, CASTS
from lintel.ir import Call, Case, Cast, Child, Lit, Make, Name, Opaque, Over, Udf, Var
from lintel.plans.passes import Import, Reads, ResolveError, effects, key, reads, resolve, simplify, variables
from lintel.plans.typecheck import CastMode, Checker, Schema, TypeCheckError
from lintel.types import ANY, BOOL, F32, F64, I8, I16, I32, I64, NULL, STRING, U8, U32, U64, Field, TypeBook, TypeFormError, ValueType, array, from_spark, mapping, struct, to_spark, to_yaml

FIELDS = (
    Field("age", I64), Field("active", BOOL), Field("score", F64, True), Field("email", STRING), Field("vip", BOOL), Field("price", F64), Field("qty", I64), Field("small", I32), Field("big", I64), Field("tiny", I8), Field("u", U32),
    Field("items", array(I64)), Field("src_ip", STRING), Field("tags", mapping(STRING, I64)), Field("payload", struct(Field("browser", STRING), Field("os", STRING), Field("status_code", I64, True))),
    Field("ts", ValueType("timestamp", precision="micros")), Field("cost", ValueType("decimal", precision=10, scale=2)),
)
SCHEMA = Schema(FIELDS, {"user": (Field("tier", STRING),)})


def typed(text, mode=CastMode.SAFE):
    return Checker(SCHEMA, mode).check(parse(text).expr)


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("age >= 18", Call("greater_or_equal", (Name("age"), Lit(18, I64)))),
        ("1u + 2.5", Call("add", (Lit(1, U64), Lit(2.5, F64)))),
        ("!!active", Call("logical_not", (Call("logical_not", (Name("active"),)),))),
        ("a.b.c", Child(Child(Name("a"), "b"), "c")),
        ("xs[0]", Call("index", (Name("xs"), Lit(0, I64)))),
        ("vip ? 'a' : 'b'", Call("conditional", (Name("vip"), Lit("a", STRING), Lit("b", STRING)))),
        ("x in [1, 2]", Call("in", (Name("x"), Make("list", (Lit(1, I64), Lit(2, I64)))))),
        ("s.matches('a')", Call("regex_match", (Name("s"), Lit("a", STRING)))),
        ("xs.exists(x, x > y)", Over("exists", Name("xs"), "x", Call("greater_than", (Var("x"), Name("y"))))),
        ("xs.map(x, x > 1, x)", Over("map_transform", Name("xs"), "x", Var("x"), Call("greater_than", (Var("x"), Lit(1, I64))))),
        ("case(a, 1, 2)", Case(((Name("a"), Lit(1, I64)),), Lit(2, I64))),
        ("a || b && c", Call("logical_or", (Name("a"), Call("logical_and", (Name("b"), Name("c")))))),
        ("1 - 2 - 3", Call("subtract", (Call("subtract", (Lit(1, I64), Lit(2, I64))), Lit(3, I64)))),
        (r"'\x41é\n'", Lit("Aé\n", STRING)),
        (r"r'\d'", Lit(r"\d", STRING)),
        ("null", Lit(None, NULL)),
        ("-x", Call("negate", (Name("x"),))),
        ("0x1F", Lit(31, I64)),
    ],
)
def test_text_becomes_trees(text, tree):
    found = parse(text)
    assert found.expr == tree and found.status is Raised.FULLY
    assert parse(write(tree)).expr == tree


def test_status_says_how_much_has_meaning():
    assert parse("age >= 18 && custom(payload)").status is Raised.PARTLY
    found = parse("frobnicate(x, y.z)")
    assert found.status is Raised.OPAQUE and found.expr == Opaque("frobnicate(x, y.z)", ("x", "y"))
    assert parse("mine(x)", ["mine"]).expr == Udf("mine", (Name("x"),))


@pytest.mark.parametrize("text", ["", "1 +", "a b", "(1", "[1, 2", "xs.map(1, x)", "size()", "regex_extract(a)", "'open", "a ? b", "#"])
def test_what_is_no_expression(text):
    with pytest.raises(CelError):
        parse(text)


LEAVES = st.sampled_from([Name("a"), Name("b"), Lit(1, I64), Lit(-2, I64), Lit(2.5, F64), Lit("q\"\\\n", STRING), Lit(None, NULL), Lit(True, BOOL), Lit(3, U64)])
TREES = st.recursive(
    LEAVES,
    lambda inner: st.one_of(
        st.builds(lambda op, a, b: Call(op, (a, b)), st.sampled_from(["add", "subtract", "multiply", "less_than", "logical_and", "logical_or", "in", "equal", "coalesce", "modulus"]), inner, inner),
        st.builds(lambda a: Call("logical_not", (a,)), inner),
        st.builds(lambda c, a, b: Call("conditional", (c, a, b)), inner, inner, inner),
        st.builds(lambda a: Child(a, "f"), st.sampled_from([Name("a"), Child(Name("b"), "g")])),
        st.builds(lambda a, b: Make("list", (a, b)), inner, inner),
        st.builds(lambda a, b: Call("index", (a, b)), st.just(Name("a")), inner),
    ),
    max_leaves=12,
)


@settings(max_examples=200, deadline=None)
@given(TREES)
def test_writing_and_reading_again(tree):
    assert parse(write(tree)).expr == tree


@pytest.mark.parametrize(
    ("text", "type"),
    [
        ("age + qty", I64), ("price * qty", F64), ("small + big", I64), ("tiny + small", I32), ("u + small", I64), ("email + 'x'", STRING), ("items + items", array(I64)), ("age == null", BOOL), ("vip ? email : null", STRING),
        ("coalesce(score, 1)", F64), ("payload.os", STRING), ("tags['a']", I64), ("tags.a", I64), ("items.map(x, double(x))", array(F64)), ("items.filter(x, x > 1)", array(I64)), ("'a' in tags", BOOL), ("age in items", BOOL),
        ("vip ? raise_error('x') : 1", I64), ("case(vip, 1, 2.5)", F64), ("size(tags)", I64), ("_.enrichments.user.tier", STRING), ("ts - ts", ValueType("duration")), ("ts + duration('1h')", ValueType("timestamp", precision="micros")),
        ("uint(age)", U64), ("type(age)", ValueType("type")), ("json_parse(email)", ANY), ("try_or_else(age / qty, 0)", I64), ("cost + cost", ValueType("decimal", precision=10, scale=2)), ("items.exists(x, x > 1) && cidr_contains(src_ip, '10/8')", BOOL),
    ],
)
def test_types(text, type):
    assert typed(text).type == type


@pytest.mark.parametrize("text", ["age + email", "nope", "payload.nope", "!age", "active < vip", "size(age)", "age ? 1 : 2", "email * 2", "items.exists(x, x)", "frob(age)", "[1, 'a']", "_.enrichments.user.nope", "age.x", "ts + ts", "contains(age, 'a')"])
def test_what_has_no_type(text):
    with pytest.raises(TypeCheckError):
        typed(text)


def test_modes():
    with pytest.raises(TypeCheckError):
        typed("small + big", CastMode.OFF)
    with pytest.raises(TypeCheckError):
        typed("email > 5")
    assert typed("email > 5", CastMode.AGGRESSIVE).type == BOOL
    # widening comes before narrowing, whatever the order
    assert typed("price * qty", CastMode.AGGRESSIVE).type == F64 == typed("qty * price", CastMode.AGGRESSIVE).type
    node = typed("small + big").node
    assert node.args[0] == Cast(Name("small"), I64)


def test_quantified_names_are_not_fields():
    tree = parse("items.exists(age, age > 1)").expr
    assert typed("items.exists(age, age > 1)").type == BOOL
    assert reads(tree.body) == Reads() and variables(tree) == set() and variables(tree.body) == {"age"}


def test_names_become_places():
    assert typed("payload.os").node == Child(Name("payload"), 1)


def test_simplification_is_sound():
    plain = lambda text: simplify(typed(text)).node
    assert plain("!!active") == Name("active") and plain("age + 0") == Name("age") == plain("1 * age") == plain("age - 0")
    assert plain("active && true") == Name("active") == plain("false || active")
    assert plain("active && false") == Lit(False, BOOL) and plain("age / qty > 1 || true") == Lit(True, BOOL)
    assert isinstance(plain("age * 0"), Call) and isinstance(plain("price + 0.0"), Call) and isinstance(plain("email + ''"), Call)


def test_keys_forget_the_order_of_operands():
    same = lambda a, b: key(parse(a).expr) == key(parse(b).expr)
    assert same("a + b", "b + a") and same("a && b == c", "c == b && a") and not same("a - b", "b - a") and not same("a.x", "a.y")


def test_what_is_read_and_done():
    of = lambda text: reads(parse(text).expr)
    assert of("1 + 2").foldable and of("age > 1") == Reads(event=True) and of("_.enrichments.user.tier") == Reads(enrichment=True)
    assert of("round_temporal(current_timestamp(), '10 minutes') > ts || current_timestamp() > ts").finest() == (0, 0)
    assert of("round_temporal(current_timestamp(), '10 minutes') > ts").finest() == (600_000, 0)
    assert of("frob(x)").aggregates and "opaque" in of("frob(x)").functions
    assert effects(typed("age / qty")) == {"may_error"} and effects(typed("score + 1.0")) == {"may_null"} and not effects(typed("age > 1"))
    assert not effects(typed("try_or_else(age / qty, 0)"))


def test_imports():
    one, two = Import("ns1", "1", "foo"), Import("ns2", "1", "foo")
    tree = parse("foo(age)", ["foo"]).expr
    assert resolve(tree, [one], {one.ref: 2}) == Udf("foo", (Name("age"), Lit(None, NULL)), one.ref)
    assert resolve(parse("bar(age)", ["bar"]).expr, [Import("ns1", "1", "foo", "bar")]).ref == one.ref
    for imports in ([], [one, two]):
        with pytest.raises(ResolveError):
            resolve(tree, imports)


def test_every_operator_can_be_typed_and_run():
    special = {"logical_and", "logical_or", "and_not", "coalesce", "try_or_else", "conditional", "raise_error"}
    assert set(CATALOG) == set(BY_OP) | set(CASTS) | special and len(COMPREHENSIONS) == 5


# --- types


def test_types_from_yaml():
    book = TypeBook.load("types:\n  Place: { struct: [ { name: name, type: string }, { name: at, type: GeoPoint } ] }\n  GeoPoint: { struct: [ { name: lat, type: f64 }, { name: lon, type: f64, nullable: true } ] }\n")
    point = struct(Field("lat", F64), Field("lon", F64, True))
    assert book.named("Place").fields[1].type == point and book.parse("{ array: { element: { ref: GeoPoint } } }") == array(point)
    assert book.parse("{ enum: [red, green] }").labels == ("red", "green") and book.parse("timestamp").precision == "millis"
    text = "{ struct: [ { name: id, type: uuid }, { name: scores, type: { map: { key: string, value: { decimal: { precision: 9, scale: 2 } }, nullable: true } } }, { name: when, type: { timestamp: { precision: nanos, timezone: utc_offset } }, nullable: true, human_name: When }, { name: owner, type: { entity_ref: { target_type_id: user, key: i64, revision_pinnable: true } } } ] }"
    assert book.parse(to_yaml(book.parse(text))) == book.parse(text)


@pytest.mark.parametrize("text", ["Nope", "{ array: { of: i64 } }", "{ struct: { a: i64 } }", "{ decimal: { precision: 40, scale: 2 } }", "[1]", "{ map: { key: f64, value: i64 } }", "{ a: 1, b: 2 }", "{ struct: [ { name: x } ] }"])
def test_what_is_no_type(text):
    with pytest.raises(TypeFormError):
        TypeBook().parse(text)


def test_no_type_holds_itself():
    with pytest.raises(TypeFormError, match="cyclic"):
        TypeBook.load("types:\n  A: { struct: [ { name: b, type: B } ] }\n  B: { struct: [ { name: a, type: A } ] }\n")


def test_spark_types(spark):
    for t in (I64, F32, I16, STRING, array(I64, True), struct(Field("a", F64, True, "a")), ValueType("decimal", precision=10, scale=2), mapping(STRING, BOOL)):
        assert from_spark(to_spark(t)) == t
    assert to_spark(U64).simpleString() == "decimal(20,0)" and to_spark(U8).simpleString() == "smallint"
    assert struct(Field("a", I64)).same(struct(Field("b", I64))) and not struct(Field("a", I64)).same(struct(Field("a", F64)))
