"""Typed expressions as Spark columns.

Every expression becomes a value column, null where it failed, and an error column that says so,
or None where it cannot fail. That pair is what lets && and || absorb errors, try_or_else tell a
failure from a null, and a filter choose what a failure means. An expression that cannot fail is a plain
native column, which Catalyst pushes down, prunes and compiles like any other.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions import net
from lintel.functions.catalog import CATALOG
from lintel.ir import Call, Case, Cast, Child, Lit, Make, Name, Over, Udf, Var
from lintel.plans.typecheck import Enriched, Typed
from lintel.types import BOOL, FLOATS, INTEGERS, ValueType, to_spark


class LowerError(ValueError):
    pass


@dataclass
class Pair:
    value: Column
    error: Column | None = None


def enriched_name(table: str, column: str) -> str:
    return f"_enriched_{table}_{column}"


def either(*errors: Column | None) -> Column | None:
    """Any of the errors; they are never null."""
    out = None
    for e in errors:
        if e is not None:
            out = e if out is None else out | e
    return out


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def literal(value, type: ValueType) -> Column:
    if value is None:
        return F.lit(None).cast(to_spark(type)) if type.kind not in ("null", "bottom") else F.lit(None)
    if type.kind == "u64":
        return F.lit(str(value)).cast("decimal(20,0)")
    return F.lit(value).cast(to_spark(type)) if type.kind in (*INTEGERS, *FLOATS) else F.lit(value)


def is_nan(k: Typed, c: Column) -> Column | None:
    """Whether c is not a number, or None where it cannot be."""
    if k.type.kind not in FLOATS or isinstance(k.node, Lit) and (k.node.value is None or not math.isnan(k.node.value)):
        return None
    if isinstance(k.node, Cast) and k.kids[0].type.kind not in FLOATS:
        return None
    return F.isnan(c)


def compared(op: str) -> Callable:
    """Comparisons in which NaN is unordered and equals nothing, unlike Spark's."""
    plain = {"equal": Column.__eq__, "not_equal": Column.__ne__, "less_than": Column.__lt__, "less_or_equal": Column.__le__, "greater_than": Column.__gt__, "greater_or_equal": Column.__ge__}[op]

    def lower(kids, cols):
        a, b = cols
        out = plain(a, b)
        for odd in (is_nan(k, c) for k, c in zip(kids, cols, strict=True)):
            if odd is not None:
                out = out | odd if op == "not_equal" else out & ~odd
        return out

    return lower


def constant(k: Typed, what: str):
    if not isinstance(k.node, Lit):
        raise LowerError(f"{what} is stated as a literal")
    return k.node.value


LOOK = re.compile(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\(\?>|[*+?}]\+")


def pattern(k: Typed, col: Column) -> Column:
    """Only what the linear-time dialects also read: no look-around, back-reference or possessive repeat."""
    if isinstance(k.node, Lit) and isinstance(k.node.value, str):
        if LOOK.search(k.node.value):
            raise LowerError(f"no look-around or back-references: {k.node.value}")
        return F.lit(re.sub(r"\(\?P<", "(?<", k.node.value))
    return col


def groups(text: str) -> int:
    return re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", text).replace("\\p{", "\\w{") if "\\p{" not in text else re.sub(r"\\[pP]\{\w+\}", ".", text)).groups


def regex_extract(kids, cols):
    s, p = cols[0], pattern(kids[1], cols[1])
    if isinstance(kids[1].node, Lit):
        return F.when(F.regexp_like(s, p), F.call_function("regexp_extract", s, p, F.lit(min(1, groups(kids[1].node.value)))))
    # a group count is not known beforehand: an empty alternative adds a first group that never matches
    whole, first = (F.call_function("regexp_extract", s, q, F.lit(i)) for q, i in ((p, 0), (F.concat(p, F.lit("|(?!)()")), 1)))
    has = F.regexp_like(F.regexp_replace(p, r"\\\\.|\\[[^\\]]*\\]", ""), F.lit(r"\((?!\?)"))
    return F.when(F.regexp_like(s, p), F.when(has, first).otherwise(whole))


def regex_replace(kids, cols):
    to = cols[2]
    if isinstance(kids[2].node, Lit) and isinstance(kids[2].node.value, str):
        text = kids[2].node.value
        if re.search(r"\$\d+[A-Za-z_]", text):
            raise LowerError("put braces around a group's number that a letter follows")
        to = F.lit(re.sub(r"\$\{(\d+)\}", r"$\1", text))
    return F.regexp_replace(cols[0], pattern(kids[1], cols[1]), to)


# The modes of URLs, schemes that always have a host, and what is stripped from a URL's ends.
MODES = ("auto", "require_scheme", "require_authority")
SPECIAL = ("http", "https", "ftp", "ws", "wss", "file")
BLANK = "".join(map(chr, range(33)))


def held(parts: dict[str, Column], body: Callable):
    """body of values by name that are worked out once, within an expression."""
    return net.let(F.struct(*(c.alias(n) for n, c in parts.items())), body)


def url(text: Column, body: Callable, bind: Callable = held):
    """body of the scheme, host, path and query of a URL or reference, taken apart leniently as browsers do; path and query are null where it is none.

    Once a character is known to be there, strings are cut at it: patterns cost a multiple. bind: how intermediate values are held.
    """

    def start(s):
        whole = F.substring_index(s.text, "#", 1)
        before = F.substring_index(whole, "?", 1)
        return bind({"before": before, "query": F.when(whole.contains("?"), F.substr(whole, F.length(before) + 2)), "scheme": F.regexp_extract(s.text, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1), "given": whole != ""}, kind)

    def kind(x):
        scheme = F.lower(x.scheme)
        return bind({"special": scheme.isin(*SPECIAL), "web": scheme.isin(*SPECIAL) & (scheme != "file")}, lambda k: rest(x, k))

    def rest(x, k):
        none = x.scheme == ""
        before = F.when(k.special | none, F.translate(x.before, "\\", "/")).otherwise(x.before)
        behind = F.when(none, before).otherwise(F.substr(before, F.length(x.scheme) + 2))
        # schemes with a host have one after any number of slashes, but for files
        return bind({"rest": F.when(k.web, F.concat(F.lit("//"), F.ltrim(behind, F.lit("/")))).otherwise(behind)}, lambda y: split(x, k, y))

    def split(x, k, y):
        authority = F.when(y.rest.startswith("//"), F.substring_index(F.substr(y.rest, F.lit(3)), "/", 1)).otherwise(F.when(y.rest.isNotNull(), F.lit("")))
        return bind({"authority": authority}, lambda z: named(x, k, y, z))

    def named(x, k, y, z):
        path = F.when(y.rest.startswith("//"), F.substr(y.rest, F.length(z.authority) + 3)).otherwise(y.rest)
        host = F.substring_index(z.authority, "@", -1)
        return bind({"host": F.when(host.contains(":"), F.regexp_replace(host, r":\d*$", "")).otherwise(host), "tail": path}, lambda h: judged(x, k, y, h))

    def judged(x, k, y, h):
        bad = h.host.rlike(r"[\x00-\x20#<>?^|%]") | (h.host.contains(":") & ~h.host.rlike(r"^\[[0-9A-Fa-f:.]+\]$")) | (k.web & (h.host == ""))
        # other schemes without slashes have no path of segments
        opaque = (x.scheme != "") & ~k.special & ~y.rest.startswith("/")
        path = F.when((h.tail != "") & ~h.tail.startswith("/"), F.concat(F.lit("/"), h.tail)).otherwise(h.tail)
        return bind({"good": ~bad & ((x.scheme != "") | x.given)}, lambda g: bind({"scheme": x.scheme, "host": h.host, "path": F.when(g.good & ~opaque, path), "query": F.when(g.good, x.query)}, body))

    return bind({"text": F.translate(F.trim(text, F.lit(BLANK)), "\t\n\r", "")}, start)


def meets(u, kids, cols, at: int) -> Column:
    """Whether a URL satisfies the mode, which is auto where it is left out or null."""
    if len(cols) <= at:
        return F.lit(True)
    has, mode = u.scheme != "", F.coalesce(cols[at], F.lit("auto"))
    full = has & (u.host != "")
    if isinstance(kids[at].node, Lit):
        return {"auto": F.lit(True), None: F.lit(True), "require_scheme": has, "require_authority": full}.get(kids[at].node.value, F.lit(False))
    return F.when(mode == "auto", F.lit(True)).when(mode == "require_scheme", has).when(mode == "require_authority", full).otherwise(F.lit(False))


ODD = r'[^!$%&\'()*+,\-./0-9:;=@A-Z\[\\\]_a-z|~]'


def encoded(segment: Column) -> Column:
    """A path's segment with the characters percent-encoded that may not stand in one."""
    each = F.transform(F.split(segment, ""), lambda c: F.when(c.rlike(ODD), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c))
    return F.when(segment.rlike(ODD), F.array_join(each, "")).otherwise(segment)


def segments(path: Column) -> Column:
    """Segments of a path, those of one and two dots worked off."""
    parts, dot, up = F.split(F.substr(path, F.lit(2)), "/", -1), "(?i)^(\\.|%2e)$", "(?i)^(\\.|%2e){2}$"
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p.rlike(dot), done).when(p.rlike(up), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))))
    walked = F.when(path.rlike(r"(?i)/(\.|%2e){1,2}$"), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    return F.when(path.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), walked).otherwise(parts)


def url_path_segment(kids, cols, at: Callable = url):
    found = at(cols[0], lambda u: F.when(meets(u, kids, cols, 2), F.get(segments(u.path), cols[1].cast("int"))))
    return net.let(found, encoded)


def decoded(text: Column) -> Column:
    """Form-decoded text; what is no escape stays."""
    return F.when(text.rlike("[%+]"), F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))).otherwise(text)


def url_query_param(kids, cols, at: Callable = url):
    def value(u) -> Column:
        named = F.filter(F.split(u.query, "&"), lambda p: (p != "") & (decoded(F.substring_index(p, "=", 1)) == cols[1]))
        return F.when(meets(u, kids, cols, 2), F.get(named, 0))

    return net.let(at(cols[0], value), lambda p: decoded(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)))


def size(kids, cols):
    kind = kids[0].type.kind
    return {"array": F.size, "map": F.size, "blob": F.octet_length}.get(kind, F.length)(cols[0]).cast("long")


PARTS = {
    "getFullYear": lambda t: F.year(t), "getMonth": lambda t: F.month(t) - 1, "getDate": lambda t: F.dayofmonth(t), "getDayOfMonth": lambda t: F.dayofmonth(t) - 1, "getDayOfWeek": lambda t: F.dayofweek(t) - 1,
    "getDayOfYear": lambda t: F.dayofyear(t) - 1, "getHours": lambda t: F.hour(t), "getMinutes": lambda t: F.minute(t), "getSeconds": lambda t: F.second(t),
    "getMilliseconds": lambda t: F.expr("0") + (F.extract(F.lit("SECOND"), t) * 1000 % 1000).cast("int"),
}


def timestamp_extract(kids, cols):
    part = constant(kids[1], "the part of a timestamp")
    return (PARTS[part](cols[0]) if part in PARTS else F.extract(F.lit(part), cols[0])).cast("long")


def round_temporal(kids, cols):
    from lintel.plans.passes import interval_ms

    unit = constant(kids[1], "the unit to round to")
    step = interval_ms(unit)
    if not step:
        raise LowerError(f"no fixed interval: {unit}")
    if " " not in unit and unit.rstrip("s") != "week":
        return F.date_trunc(unit.rstrip("s"), cols[0]).cast("timestamp_ntz")
    micros = F.unix_micros(cols[0].cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(step * 1000))).cast("timestamp_ntz")


def round_calendar(kids, cols):
    return F.date_trunc(constant(kids[1], "the unit to round to"), cols[0]).cast("timestamp_ntz")


DURATION = r"^-?(?:(?:\d+(?:\.\d*)?|\.\d+)(?:h|ms|m|s|us|ns))+$"


def duration(text: Column) -> Column:
    """A duration such as 1h30m or -1.5s; null for other text. Finer parts than a microsecond are cut off."""
    micros = F.lit(0.0)
    for unit, scale in (("h", 3.6e9), ("m(?!s)", 6e7), (r"(?<![mun])s", 1e6), ("ms", 1e3), ("us", 1.0), ("ns", 1e-3)):
        found = F.regexp_extract_all(text, F.lit(rf"(\d+(?:\.\d*)?|\.\d+){unit}"), F.lit(1))
        micros = micros + F.aggregate(found, F.lit(0.0), lambda sum_, x: sum_ + x.try_cast("double")) * scale
    signed = F.when(text.startswith("-"), -micros).otherwise(micros)
    return F.when(text.rlike(DURATION), F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (signed / 1e6).cast("decimal(18,6)")))


def cast(of: Typed, c: Column, to: ValueType) -> Column:
    """Null where a value has no such form."""
    a, b = of.type.kind, to.kind
    if a in ("null", "bottom"):
        return F.lit(None).cast(to_spark(to))
    if b in FLOATS and a == "bool":
        return c.cast("int").cast(to_spark(to))
    if b in INTEGERS and a == "timestamp":
        return F.unix_seconds(c.cast("timestamp"))
    if b == "bool" and a == "string":
        return F.when(c.isin("true", "t", "1", "TRUE", "True"), True).when(c.isin("false", "f", "0", "FALSE", "False"), False)
    if b == "duration":
        return c if a == "duration" else F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), c.cast("decimal(18,6)")) if a in INTEGERS else duration(c)
    if b == "timestamp":
        return F.timestamp_seconds(c).cast("timestamp_ntz") if a in INTEGERS else F.expr("try_cast(null as timestamp_ntz)") if a not in ("string", "date", "timestamp") else c.try_cast("timestamp_ntz")
    if b == "blob":
        return c if a == "blob" else F.encode(c.cast("string"), "utf-8")
    if b == "string":
        return F.try_variant_get(c, "$", "string") if a == "any" else F.decode(c, "utf-8") if a == "blob" else c.cast("string")
    if a == "any":
        return F.try_variant_get(c, "$", to_spark(to).simpleString())
    if b in INTEGERS and a in FLOATS:
        c = F.when(F.isnan(c), None).otherwise(c)
    out = c.try_cast(to_spark(to))
    low, high = {"u8": (0, 255), "u16": (0, 65535), "u32": (0, 2**32 - 1), "u64": (0, 2**64 - 1)}.get(b, (None, None))
    return out if low is None else F.when(out.between(F.lit(low), F.lit(str(high)).cast("decimal(20,0)")), out)


def whole(kids, c: Column) -> Column:
    return c.cast(to_spark(kids[0].type))


def divided(kids, cols):
    a, b = cols
    if kids[0].type.kind in FLOATS:
        infinite = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when((a > 0) == ~(b.cast("string") == "-0.0"), F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
        return F.when(b == 0, F.when(a.isNotNull(), infinite)).otherwise(F.try_divide(a, b)).cast(to_spark(kids[0].type))
    # toward zero; the least number over -1 overflows
    out = F.when(b == 0, None).when(b == -1, F.try_subtract(literal(0, kids[0].type), a)).otherwise(F.call_function("div", a, F.when(b == 0, 1).otherwise(b)))
    return out.try_cast(to_spark(kids[0].type))


def logged(fn):
    """As IEEE has it: minus infinity at zero and NaN below."""
    return lambda kids, cols: F.when(cols[0] > 0, fn(cols[0])).when(cols[0] == 0, F.lit(float("-inf"))).when(cols[0].isNotNull(), F.lit(float("nan")))


def added(kids, cols):
    kinds = {k.type.kind for k in kids}
    if kinds <= {"string", "blob", "array", "fixedchar", "clob"}:
        return F.concat(*cols)
    if "duration" in kinds or "timestamp" in kinds:
        a, b = cols
        if kinds == {"duration"}:
            return F.try_add(a, b)
        moment, step = (a, b) if kids[1].type.kind == "duration" else (b, a)
        return F.try_add(moment.cast("timestamp_ntz"), step)
    return F.try_add(*cols)


def subtracted(kids, cols):
    if kids[0].type.kind in ("timestamp", "date") and kids[1].type.kind == "duration":
        return F.try_subtract(cols[0].cast("timestamp_ntz"), cols[1])
    if kids[0].type.kind in ("timestamp", "date"):
        return cols[0].cast("timestamp_ntz") - cols[1].cast("timestamp_ntz")
    return F.try_subtract(*cols)


def sized(op):
    """Arithmetic whose Spark form may be wider than its operands: brought back, null where it does not fit."""
    return lambda kids, cols: op(*cols).try_cast(to_spark(kids[0].type))


def index(kids, cols):
    if kids[0].type.kind == "map":
        return F.try_element_at(cols[0], cols[1])
    at = cols[1]
    return F.get(cols[0], F.when(at.between(0, 2**31 - 1), at).otherwise(-1).cast("int"))


def member(kids, cols):
    x, of = cols
    if kids[1].type.kind == "map":
        return F.map_contains_key(of, x)
    if isinstance(kids[1].node, Make) and kids[1].node.parts and all(isinstance(p, Lit) and p.value is not None for p in kids[1].node.parts):
        return x.isin([p.value for p in kids[1].node.parts])
    return F.array_contains(of, x)


def cidr_match(kids, cols):
    if isinstance(kids[1].node, Make) and all(isinstance(p, Lit) for p in kids[1].node.parts):
        return net.in_any(cols[0], [p.value for p in kids[1].node.parts])
    return F.when(cols[0].isNotNull() & cols[1].isNotNull(), F.exists(cols[1], lambda c: sure(net.in_block_of(cols[0], c))))


def json_extract_string(kids, cols):
    """A scalar's text; null for objects, arrays, null and what is not JSON."""
    return scalar_json(cols[0], constant(kids[1], "a JSON path"))


def scalar_json(text: Column, path: str) -> Column:
    found = F.try_variant_get(F.try_parse_json(text), path, "variant")
    kind = F.schema_of_variant(found)
    return F.when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY") & (kind != "VOID"), F.get_json_object(text, path))


def padded(side: str):
    return lambda kids, cols: F.call_function(side, cols[0], cols[1].cast("int"), cols[2] if len(cols) > 2 else F.lit(" "))


def centred(kids, cols):
    """As many on both sides, one more behind where it does not come out even; text that is wide enough stays."""
    s, wide, by = cols[0], cols[1].cast("int"), cols[2] if len(cols) > 2 else F.lit(" ")
    ahead = F.call_function("lpad", s, F.length(s) + F.floor((wide - F.length(s)) / 2).cast("int"), by)
    return F.when(F.length(s) >= wide, s).otherwise(F.call_function("rpad", ahead, wide, by))


def extract_boolean(kids, cols):
    part = constant(kids[1], "the part of a timestamp")
    if part.lower() != "is_leap_year":
        raise LowerError(f"no boolean part: {part}")
    year = F.year(cols[0])
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def time_of_day(kids, cols):
    """The time that a text states, as what has passed since midnight."""
    moment = F.try_to_timestamp(*cols).cast("timestamp_ntz")
    return moment - F.date_trunc("day", moment).cast("timestamp_ntz")


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def stringified(kids, cols):
    if kids[0].type.kind in ("struct", "array", "map", "any"):
        return F.to_json(cols[0])
    # a scalar is written as the one element of a list
    return F.when(cols[0].isNotNull(), F.regexp_extract(F.to_json(F.array(cols[0])), r"(?s)^\[(.*)\]$", 1))


FLOAT = lambda f: lambda kids, cols: f(cols[0]).cast("double")
PLAIN = lambda f: lambda kids, cols: f(*cols)
INF = float("inf")
BY_OP: dict[str, Callable] = {
    "logical_not": PLAIN(lambda a: ~a),
    "xor": PLAIN(lambda a, b: a != b),
    **{op: compared(op) for op in ("equal", "not_equal", "less_than", "less_or_equal", "greater_than", "greater_or_equal")},
    "between": lambda kids, cols: compared("greater_or_equal")(kids[:2], cols[:2]) & compared("less_or_equal")([kids[0], kids[2]], [cols[0], cols[2]]),
    "null_safe_equal": PLAIN(lambda a, b: a.eqNullSafe(b)),
    "null_safe_not_equal": PLAIN(lambda a, b: ~a.eqNullSafe(b)),
    "is_null": PLAIN(lambda a: a.isNull()),
    "is_not_null": PLAIN(lambda a: a.isNotNull()),
    "is_nan": PLAIN(lambda a: F.when(a.isNotNull(), F.isnan(a))),
    "is_finite": PLAIN(lambda a: ~F.isnan(a) & (F.abs(a) != INF)),
    "is_infinite": PLAIN(lambda a: F.abs(a) == INF),
    "least": PLAIN(lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))),
    "greatest": PLAIN(lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))),
    "add": added,
    "subtract": subtracted,
    "multiply": PLAIN(lambda a, b: F.try_multiply(a, b)),
    "divide": divided,
    "modulus": lambda kids, cols: F.try_mod(*cols) if kids[0].type.kind not in FLOATS else F.when(cols[1] == 0, F.lit(float("nan"))).otherwise(F.try_mod(*cols)),
    "negate": lambda kids, cols: F.try_subtract(literal(0, kids[0].type), cols[0]) if kids[0].type.kind not in FLOATS else -cols[0],
    "abs": lambda kids, cols: F.abs(cols[0]) if kids[0].type.kind in (*FLOATS, "decimal") else F.when(cols[0] < 0, F.try_subtract(literal(0, kids[0].type), cols[0])).otherwise(cols[0]),
    "power": sized(F.pow),
    "sqrt": PLAIN(F.sqrt),
    "exp": PLAIN(F.exp),
    "sign": sized(F.signum),
    "ln": logged(F.ln),
    "log10": logged(F.log10),
    "ceil": FLOAT(lambda a: F.when(F.isnan(a) | (F.abs(a) >= 2.0**52), a).otherwise(F.ceil(a).cast("double"))),
    "floor": FLOAT(lambda a: F.when(F.isnan(a) | (F.abs(a) >= 2.0**52), a).otherwise(F.floor(a).cast("double"))),
    "round": PLAIN(F.round),
    "duration_multiply": PLAIN(lambda a, b: F.try_multiply(a, b)),
    "contains": PLAIN(F.contains),
    "starts_with": PLAIN(F.startswith),
    "ends_with": PLAIN(F.endswith),
    "regex_match": lambda kids, cols: F.regexp_like(cols[0], pattern(kids[1], cols[1])),
    "regex_extract": regex_extract,
    "regex_replace": regex_replace,
    "url_path_segment": url_path_segment,
    "url_query_param": url_query_param,
    "size": size,
    "list_cardinality": size,
    "lower": PLAIN(F.lower),
    "upper": PLAIN(F.upper),
    "substring": PLAIN(lambda s, a, n: F.substr(s, a.cast("int"), n.cast("int"))),
    "replace": PLAIN(F.replace),
    "trim": PLAIN(lambda s: F.trim(s)),
    "ltrim": PLAIN(lambda s: F.ltrim(s)),
    "rtrim": PLAIN(lambda s: F.rtrim(s)),
    "left": PLAIN(lambda s, n: F.left(s, n.cast("int"))),
    "right": PLAIN(lambda s, n: F.right(s, n.cast("int"))),
    "string_split": PLAIN(lambda s, by: F.split(s, F.concat(F.lit(r"\Q"), by, F.lit(r"\E")), -1)),
    "regexp_string_split": lambda kids, cols: F.split(cols[0], pattern(kids[1], cols[1]), -1),
    "regexp_match_all": lambda kids, cols: F.regexp_extract_all(cols[0], pattern(kids[1], cols[1]), F.lit(0)),
    "regexp_strpos": lambda kids, cols: F.regexp_instr(cols[0], pattern(kids[1], cols[1])).cast("long"),
    "regexp_count_substring": lambda kids, cols: F.regexp_count(cols[0], pattern(kids[1], cols[1])).cast("long"),
    "count_substring": PLAIN(lambda s, x: F.when(x == "", F.lit(0).cast("long")).otherwise(((F.length(s) - F.length(F.replace(s, x, F.lit("")))) / F.nullif(F.length(x), F.lit(0))).cast("long"))),
    "string_position": PLAIN(lambda s, x: F.position(x, s).cast("long")),
    "concat": PLAIN(F.concat),
    "concat_ws": lambda kids, cols: F.call_function("concat_ws", *cols),
    "timestamp_extract": timestamp_extract,
    "round_temporal": round_temporal,
    "round_calendar": round_calendar,
    "assume_timezone": PLAIN(lambda t, zone: F.convert_timezone(F.lit("UTC"), zone, t)),
    "current_timestamp": lambda kids, cols: F.current_timestamp().cast("timestamp_ntz"),
    "datetime_format": PLAIN(lambda t, form: F.call_function("date_format", t, form)),
    "datetime_parse": PLAIN(lambda s, *form: F.try_to_timestamp(s, *form).cast("timestamp_ntz")),
    "type_of": lambda kids, cols: F.lit(str(kids[0].type)),
    "dyn": PLAIN(lambda a: a),
    "index": index,
    "in": member,
    "list_sort": PLAIN(F.array_sort),
    "has": PLAIN(lambda a: a.isNotNull()),
    "json_parse": PLAIN(F.try_parse_json),
    "json_parse_struct": lambda kids, cols: F.when(F.try_parse_json(cols[0]).isNotNull(), F.from_json(cols[0], constant(kids[1], "a JSON schema"))),
    "json_stringify": stringified,
    "json_extract": lambda kids, cols: F.try_variant_get(F.try_parse_json(cols[0]), constant(kids[1], "a JSON path"), "variant"),
    "json_extract_string": json_extract_string,
    "cidr_contains": lambda kids, cols: net.in_block(cols[0], kids[1].node.value) if isinstance(kids[1].node, Lit) else net.in_block_of(*cols),
    "cidr_match": cidr_match,
    "is_true": PLAIN(lambda a: a.eqNullSafe(True)),
    "is_not_true": PLAIN(lambda a: ~a.eqNullSafe(True)),
    "is_false": PLAIN(lambda a: a.eqNullSafe(False)),
    "is_not_false": PLAIN(lambda a: ~a.eqNullSafe(False)),
    "nullif": lambda kids, cols: F.when(~sure(compared("equal")(kids, cols)), cols[0]),
    "least_skip_null": PLAIN(F.least),
    "greatest_skip_null": PLAIN(F.greatest),
    "factorial": PLAIN(F.factorial),
    **{op: PLAIN(getattr(F, op)) for op in ("sin", "cos", "tan", "asin", "acos", "atan", "atan2", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh", "radians", "degrees")},
    "bitwise_not": PLAIN(F.bitwise_not),
    "bitwise_and": PLAIN(lambda a, b: a.bitwiseAND(b)),
    "bitwise_or": PLAIN(lambda a, b: a.bitwiseOR(b)),
    "bitwise_xor": PLAIN(lambda a, b: a.bitwiseXOR(b)),
    "shift_left": PLAIN(lambda a, n: F.call_function("shiftleft", a, n.cast("int"))),
    "shift_right": PLAIN(lambda a, n: F.call_function("shiftright", a, n.cast("int"))),
    "shift_right_unsigned": PLAIN(lambda a, n: F.call_function("shiftrightunsigned", a, n.cast("int"))),
    "log2": logged(F.log2),
    "logb": lambda kids, cols: logged(F.ln)(kids, cols) / logged(F.ln)(kids[1:], cols[1:]),
    "log1p": lambda kids, cols: F.when(cols[0] > -1, F.log1p(cols[0])).when(cols[0] == -1, F.lit(float("-inf"))).when(cols[0].isNotNull(), F.lit(float("nan"))),
    "like": PLAIN(lambda s, like: F.like(s, like)),
    "repeat": PLAIN(lambda s, n: F.repeat(s, n.cast("int"))),
    "reverse": PLAIN(F.reverse),
    "replace_slice": PLAIN(lambda s, at, n, by: F.overlay(s, by, at.cast("int"), n.cast("int"))),
    "swapcase": PLAIN(lambda s: F.translate(s, LETTERS + LETTERS.upper(), LETTERS.upper() + LETTERS)),
    "capitalize": PLAIN(lambda s: F.concat(F.upper(F.left(s, F.lit(1))), F.substr(s, F.lit(2)))),
    "title": PLAIN(F.initcap),
    "initcap": PLAIN(F.initcap),
    "bit_length": PLAIN(lambda s: F.bit_length(s).cast("long")),
    "lpad": padded("lpad"),
    "rpad": padded("rpad"),
    "center": centred,
    "extract_boolean": extract_boolean,
    "strptime_date": PLAIN(lambda s, form: F.try_to_timestamp(s, form).cast("date")),
    "strptime_time": time_of_day,
    "ip_to_int": PLAIN(net.v4_number),
    "int_to_ip": PLAIN(net.number_v4),
}
URLS = ("url_path_segment", "url_query_param")
CASTS = {"cast_bool": "bool", "cast_int": "i64", "cast_uint": "u64", "cast_double": "f64", "cast_string": "string", "cast_bytes": "blob", "cast_duration": "duration", "cast_timestamp": "timestamp"}


class Lowering:
    def __init__(self, functions: Mapping | None = None, urls: Iterable[tuple[Typed, SimpleNamespace]] = ()):
        self.functions, self.urls = functions or {}, list(urls)

    def lower(self, t: Typed, scope: Mapping[str, Column] | None = None) -> Pair:
        scope = scope or {}
        match t.node:
            case Lit(value, type):
                return Pair(literal(value, type))
            case Name(name):
                return Pair(F.col("`" + name.replace("`", "``") + "`"))
            case Var(name):
                return Pair(scope[name])
            case Enriched(table, column):
                return Pair(F.col(enriched_name(table, column)))
            case Child(_, field):
                of = self.lower(t.kids[0], scope)
                if t.kids[0].type.kind == "any":
                    return Pair(F.try_variant_get(of.value, f"$.{field}", "variant"), of.error)
                return Pair(of.value.getField(t.kids[0].type.fields[field].name), of.error)
            case Cast(_, to):
                of = self.lower(t.kids[0], scope)
                return self.failing(cast(t.kids[0], of.value, to), of.error, [of.value], t.may_error)
            case Case():
                return self.case(t, scope)
            case Make(kind, _, names):
                parts = [self.lower(k, scope) for k in t.kids]
                cols = [p.value for p in parts]
                made = F.array(*cols) if kind == "list" else F.create_map(*cols) if kind == "map" else F.struct(*(c.alias(n) for c, n in zip(cols, names, strict=True)))
                return Pair(made.cast(to_spark(t.type)) if not cols else made, either(*(p.error for p in parts)))
            case Over():
                return self.over(t, scope)
            case Udf():
                args = [self.lower(k, scope) for k in t.kids]
                return Pair(self.functions[t.node.ref].column(*(a.value for a in args)), either(*(a.error for a in args)))
            case Call():
                return self.call(t, scope)
        raise LowerError(f"no column for {t.node!r}")

    @staticmethod
    def failing(value: Column, error: Column | None, operands: list[Column], may: bool) -> Pair:
        """Operands that are not null with a null result have failed."""
        if not may:
            return Pair(value, error)
        own = value.isNull()
        for c in operands:
            own = own & c.isNotNull()
        return Pair(value, either(error, own))

    def call(self, t: Typed, scope) -> Pair:
        op, kids = t.node.op, t.kids
        args = [self.lower(k, scope) for k in kids]
        cols, errors = [a.value for a in args], [a.error for a in args]
        if op in ("logical_and", "logical_or", "and_not"):
            a, b = cols[0], ~cols[1] if op == "and_not" else cols[1]
            decides = (lambda c: sure(~c)) if op != "logical_or" else sure
            value = a & b if op != "logical_or" else a | b
            if either(*errors) is None:
                return Pair(value)
            # an error counts unless the other side decides without one
            fails = [None if e is None else e & ~(decides(o) if oe is None else decides(o) & ~oe) for e, o, oe in ((errors[0], b, errors[1]), (errors[1], a, errors[0]))]
            return Pair(value, either(*fails))
        if op == "coalesce":
            second = None if errors[1] is None else cols[0].isNull() & errors[1]
            return Pair(F.coalesce(*cols), either(errors[0], second))
        if op == "try_or_else":
            if errors[0] is None:
                return args[0]
            return Pair(F.when(errors[0], cols[1]).otherwise(cols[0]), None if errors[1] is None else errors[0] & errors[1])
        if op == "conditional":
            branch = None if errors[1] is None and errors[2] is None else F.when(cols[0], sure(errors[1] if errors[1] is not None else F.lit(False))).otherwise(sure(errors[2] if errors[2] is not None else F.lit(False)))
            return Pair(F.when(cols[0], cols[1]).otherwise(cols[2]), either(errors[0], branch))
        if op == "raise_error":
            return Pair(F.lit(None), F.lit(True))
        if op in CASTS:
            return self.failing(cast(kids[0], cols[0], t.type), either(*errors), cols, t.may_error)
        known = [u for of, u in self.urls if of == kids[0]] if op in URLS else []
        value = BY_OP[op](list(kids), cols, lambda _, body: body(known[0])) if known else BY_OP[op](list(kids), cols)
        own = "error" in CATALOG[op].flags and t.may_error
        if op == "index" and own:
            # a null element is no failure: the place is what has to be there
            missing = ~F.map_contains_key(*cols) if kids[0].type.kind == "map" else (cols[1] < 0) | (cols[1] >= F.size(cols[0]))
            return Pair(value, either(*errors, sure(missing)))
        return self.failing(value, either(*errors), cols, own)

    def case(self, t: Typed, scope) -> Pair:
        kids = [self.lower(k, scope) for k in t.kids]
        value, error, fails = F, F, either(*(k.error for k in kids)) is not None
        for c, v in zip(kids[0:-1:2], kids[1:-1:2], strict=True):
            value = value.when(c.value, v.value)
            if fails:
                no = F.lit(False)
                error = error.when(c.error if c.error is not None else no, F.lit(True)).when(c.value, v.error if v.error is not None else no)
        value = value.otherwise(kids[-1].value)
        return Pair(value, error.otherwise(kids[-1].error if kids[-1].error is not None else F.lit(False)) if fails else None)

    def over(self, t: Typed, scope) -> Pair:
        op, var = t.node.op, t.node.var
        of = self.lower(t.kids[0], scope)
        items = F.map_keys(of.value) if t.kids[0].type.kind == "map" else of.value

        def body(at: int) -> tuple[Callable, Callable | None]:
            """(value of the body, its error) as functions of an element."""
            kid = t.kids[at]
            value = lambda x: self.lower(kid, {**scope, var: x}).value
            fails = kid.may_error and self.lower(kid, {**scope, var: F.lit(None).cast(to_spark(element(t.kids[0].type)))}).error is not None
            return value, (lambda x: sure(self.lower(kid, {**scope, var: x}).error)) if fails else None

        value, error = body(1)
        any_error = None if error is None else sure(F.exists(items, error))
        if op == "map_transform":
            if len(t.kids) > 2:
                where, where_error = body(2)
                items = F.filter(items, where)
                any_error = either(None if error is None else sure(F.exists(items, error)), None if where_error is None else sure(F.exists(of.value, where_error)))
            return Pair(F.transform(items, value), either(of.error, any_error))
        if op == "filter":
            return Pair(F.filter(items, value), either(of.error, any_error))
        if op == "exists_one":
            return Pair(F.when(items.isNotNull(), F.size(F.filter(items, value)) == 1), either(of.error, any_error))
        if error is None:
            return Pair(F.forall(items, value) if op == "all" else F.exists(items, value), of.error)
        # an element that decides without an error makes the others' errors not count
        decides = sure(F.exists(items, (lambda x: sure(~value(x)) & ~error(x)) if op == "all" else (lambda x: sure(value(x)) & ~error(x))))
        out = F.when(decides, F.lit(op == "exists")).otherwise(F.forall(items, value) if op == "all" else F.exists(items, value))
        return Pair(out, either(of.error, any_error & ~decides))


def element(t: ValueType) -> ValueType:
    return t.key if t.kind == "map" else t.element


def nodes(t: Typed) -> Iterator[Typed]:
    yield t
    for kid in t.kids:
        yield from nodes(kid)


def with_urls(df: DataFrame, typed: Iterable[Typed], functions: Mapping | None = None) -> tuple[DataFrame, list[tuple[Typed, SimpleNamespace]]]:
    """df with the parts of the URLs that expressions read as further columns, so that a row's is taken apart once for all of them.

    Left out are URLs of elements of a collection, of outside functions, and those that may fail.
    """
    found: list[tuple[Typed, SimpleNamespace]] = []
    for node in (n for t in typed for n in nodes(t) if isinstance(n.node, Call) and n.node.op in URLS):
        of = node.kids[0]
        if any(of == known for known, _ in found) or any(isinstance(n.node, (Var, Udf, Over)) for n in nodes(of)):
            continue
        pair = Lowering(functions).lower(of)
        if pair.error is not None:
            continue

        def bind(parts: dict[str, Column], body: Callable):
            nonlocal df
            names = {n: f"_url_{len(df.columns)}_{n}" for n in parts}
            df = df.withColumns({names[n]: c for n, c in parts.items()})
            return body(SimpleNamespace(**{n: F.col(c) for n, c in names.items()}))

        found.append((of, url(pair.value, lambda u: u, bind)))
    return df, found


def column(t: Typed, functions: Mapping | None = None, on_error: str = "raise", urls: Iterable[tuple[Typed, SimpleNamespace]] = ()) -> Column:
    """The column of a checked expression; on_error: raise, null, or, for conditions, false. urls: those of with_urls."""
    pair = Lowering(functions, urls).lower(t)
    if pair.error is None:
        return pair.value
    if on_error == "raise":
        return F.when(pair.error, F.raise_error(F.lit("expression failed"))).otherwise(pair.value)
    if on_error == "null":
        return F.when(~pair.error, pair.value)
    if t.type != BOOL:
        raise LowerError("only a condition can be false where it fails")
    return sure(pair.value) & ~pair.error
