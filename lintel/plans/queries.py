"""One query for each operator or family of operators, with the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.engine import Engine
from lintel.functions.udf import Registry
from lintel.operators.aggregates import Aggregate, aggregate
from lintel.operators.validation import Rule, Rules, checked, split
from lintel.operators.windows import Over, over
from lintel.plans.passes import Import
from lintel.plans.typecheck import CastMode
from lintel.sources.events import read_events
from lintel.streaming.windows import bucket, windowed
from lintel.types import TypeBook

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Projection:
    """Expressions over a table beside its key, filtered first if there is a condition."""

    table: str
    keep: tuple[str, ...]
    exprs: dict[str, str]
    sql: str
    where: str | None = None
    on_error: str = "raise"
    prepare: str | None = None  # SQL columns that the expressions read, over the table

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df, engine = read(spark, sf_dir, self.table), Engine()
        if self.prepare:
            df = df.selectExpr("*", *self.prepare.split(" ; "))
        if self.where:
            df = engine.filter(df, self.where, "false" if self.on_error != "raise" else "raise")
        return engine.select(df, self.on_error, self.keep, **self.exprs) if self.exprs else df.select(*self.keep)


IP = "concat('10.', cast(o_custkey % 256 as string), '.', cast(o_orderkey % 7 as string), '.1') as ip"
SQL_IP = "'10.' || (o_custkey % 256)::varchar || '.' || (o_orderkey % 7)::varchar || '.1'"

PROJECTIONS: dict[str, Projection] = {
    "filter_predicate": Projection("events", ("event_id", "event_type", "value"), {}, "select event_id, event_type, value from events where value >= 18 and ends_with(event_type, 'p')", "value >= 18 && event_type.endsWith('p')"),
    "logical": Projection(
        "part",
        ("p_partkey",),
        {"both": "p_size > 10 && p_retailprice < 1500.0", "any_": "p_size > 40 || p_size < 5", "neither": "!(p_size > 10)", "but": "and_not(p_size > 10, p_size > 20)", "one": "xor(p_size > 10, p_size > 20)"},
        "select p_partkey, p_size > 10 and p_retailprice < 1500.0 as both, p_size > 40 or p_size < 5 as any_, not p_size > 10 as neither, p_size > 10 and not p_size > 20 as but, (p_size > 10) <> (p_size > 20) as one from part",
    ),
    "comparison": Projection(
        "lineitem",
        ("l_orderkey", "l_linenumber"),
        {"eq": "l_quantity == 17", "ne": "l_quantity != 17", "lt": "l_quantity < 17", "le": "l_quantity <= 17", "gt": "l_quantity > 17", "ge": "l_quantity >= 17", "mid": "between(l_quantity, 10, 20)"},
        "select l_orderkey, l_linenumber, l_quantity = 17 as eq, l_quantity <> 17 as ne, l_quantity < 17 as lt, l_quantity <= 17 as le, l_quantity > 17 as gt, l_quantity >= 17 as ge, l_quantity between 10 and 20 as mid from lineitem",
    ),
    "null_handling": Projection(
        "orders",
        ("o_orderkey",),
        {"none": "is_null(s)", "some": "is_not_null(s)", "or_else": "coalesce(s, 'none')", "same": "null_safe_equal(s, null)", "differs": "null_safe_not_equal(s, 'O')", "low": "least(n, 5)", "high": "greatest(n, 5)", "there": "has(r.s)"},
        "with t as (select o_orderkey, nullif(o_orderstatus, 'F') as s, nullif(o_custkey % 10, 3) as n from orders) select o_orderkey, s is null as none, s is not null as some, coalesce(s, 'none') as or_else, s is not distinct from null as same, s is distinct from 'O' as differs, case when n is not null then least(n, 5) end as low, case when n is not null then greatest(n, 5) end as high, s is not null as there from t",
        prepare="nullif(o_orderstatus, 'F') as s ; nullif(o_custkey % 10, 3) as n ; named_struct('s', nullif(o_orderstatus, 'F')) as r",
    ),
    "floating_kinds": Projection(
        "orders",
        ("o_orderkey",),
        {"nan": "is_nan(d)", "finite": "is_finite(d)", "infinite": "is_infinite(d)", "equal_": "d == d", "above": "d > 1.0"},
        "with t as (select o_orderkey, case when o_custkey % 3 = 0 then 'nan'::double when o_custkey % 3 = 1 then 'inf'::double else 2.0 end as d from orders) select o_orderkey, isnan(d) as nan, isfinite(d) as finite, isinf(d) as infinite, not isnan(d) as equal_, not isnan(d) and d > 1.0 as above from t",
        prepare="case when o_custkey % 3 = 0 then double('NaN') when o_custkey % 3 = 1 then double('Infinity') else 2.0D end as d",
    ),
    "arithmetic": Projection(
        "lineitem",
        ("l_orderkey", "l_linenumber"),
        {"plus": "l_orderkey + l_linenumber", "minus": "l_orderkey - 7", "times": "l_linenumber * 3", "over": "(l_orderkey - 7) / 4", "rest": "(l_orderkey - 7) % 4", "neg": "-l_orderkey", "size_": "abs(7 - l_orderkey)", "squared": "power(l_linenumber, 2)", "signed": "sign(l_orderkey - 100)", "part": "l_extendedprice / 2.0"},
        "select l_orderkey, l_linenumber, l_orderkey + l_linenumber as plus, l_orderkey - 7 as minus, (l_linenumber * 3)::bigint as times, (l_orderkey - 7) // 4 as over, (l_orderkey - 7) % 4 as rest, -l_orderkey as neg, abs(7 - l_orderkey) as size_, (l_linenumber * l_linenumber)::bigint as squared, sign(l_orderkey - 100)::bigint as signed, l_extendedprice / 2.0 as part from lineitem",
    ),
    "math": Projection(
        "part",
        ("p_partkey",),
        {"root": "round(sqrt(p_retailprice) * 1000.0)", "grown": "round(exp(double(p_size) / 50.0) * 1000.0)", "natural": "round(ln(p_retailprice) * 1000.0)", "tens": "round(log10(p_retailprice) * 1000.0)", "up": "ceil(p_retailprice)", "down": "floor(p_retailprice)", "near": "round(p_retailprice)", "at_zero": "ln(0.0)", "per_zero": "double(p_size) / 0.0"},
        "select p_partkey, round(sqrt(p_retailprice) * 1000) as root, round(exp(p_size / 50.0) * 1000) as grown, round(ln(p_retailprice) * 1000) as natural, round(log10(p_retailprice) * 1000) as tens, ceil(p_retailprice)::double as up, floor(p_retailprice)::double as down, round(p_retailprice) as near, '-inf'::double as at_zero, 'inf'::double as per_zero from part",
    ),
    "try_or_else": Projection("lineitem", ("l_orderkey", "l_linenumber"), {"share": "try_or_else(l_orderkey / (int(l_linenumber) - 2), -1)"}, "select l_orderkey, l_linenumber, coalesce(l_orderkey // nullif(l_linenumber - 2, 0), -1)::bigint as share from lineitem"),
    "error_absorption": Projection("lineitem", ("l_orderkey", "l_linenumber"), {}, "select l_orderkey, l_linenumber from lineitem where l_linenumber > 2 and 10 // nullif(l_linenumber - 2, 0) > 1", "10 / (l_linenumber - 2) > 1 && l_linenumber > 2", "null"),
    "raise_error": Projection("orders", ("o_orderkey",), {"status": "try_or_else(o_orderstatus == 'F' ? raise_error('final') : o_orderstatus, 'closed')"}, "select o_orderkey, case when o_orderstatus = 'F' then 'closed' else o_orderstatus end as status from orders"),
    "string_tests": Projection("customer", ("c_custkey",), {"has_": "c_name.contains('1')", "begins": "c_name.startsWith('C')", "ends": "c_name.endsWith('9')", "found": "c_mktsegment.matches('^[AB]')"}, "select c_custkey, contains(c_name, '1') as has_, starts_with(c_name, 'C') as begins, ends_with(c_name, '9') as ends, regexp_matches(c_mktsegment, '^[AB]') as found from customer"),
    "string_functions": Projection(
        "nation",
        ("n_nationkey",),
        {"low": "lower(n_name)", "up": "upper(n_name)", "n": "size(n_name)", "part": "substring(n_name, 2, 3)", "changed": "replace(n_name, 'A', '-')", "bare": "trim('  x ')", "bare_l": "ltrim('  x ')", "bare_r": "rtrim('  x ')", "l": "left(n_name, 2)", "r": "right(n_name, 2)", "at": "string_position(n_name, 'A')", "joined": "concat(n_name, '!')", "added": "n_name + '?'", "with_": "concat_ws('-', n_name, 'x')", "times": "count_substring(n_name, 'A')"},
        "select n_nationkey, lower(n_name) as low, upper(n_name) as up, length(n_name)::bigint as n, substring(n_name, 2, 3) as part, replace(n_name, 'A', '-') as changed, 'x' as bare, 'x ' as bare_l, '  x' as bare_r, left(n_name, 2) as l, right(n_name, 2) as r, strpos(n_name, 'A')::bigint as at, n_name || '!' as joined, n_name || '?' as added, n_name || '-x' as with_, (length(n_name) - length(replace(n_name, 'A', '')))::bigint as times from nation",
    ),
    "string_split": Projection("pages", ("page_id",), {"parts": "size(string_split(url, '/'))", "first_": "string_split(url, '/')[2]", "digits": "size(regexp_string_split(url, '[0-9]+'))"}, "select page_id, len(string_split(url, '/'))::bigint as parts, string_split(url, '/')[3] as first_, len(regexp_split_to_array(url, '[0-9]+'))::bigint as digits from pages"),
    "regex_match": Projection("documents", ("doc_id",), {}, "select doc_id from documents where regexp_matches(text, '[0-9]{3}-[0-9]{4}')", "text.matches('[0-9]{3}-[0-9]{4}')"),
    "regex_extract": Projection("pages", ("page_id",), {"host": "regex_extract(url, '^https?://([^/]+)')", "number": "regex_extract(url, '[0-9]{4,}')"}, "select page_id, case when regexp_matches(url, '^https?://([^/]+)') then regexp_extract(url, '^https?://([^/]+)', 1) end as host, case when regexp_matches(url, '[0-9]{4,}') then regexp_extract(url, '[0-9]{4,}') end as number from pages"),
    "regex_replace": Projection("pages", ("page_id",), {"hidden": "regex_replace(url, '[0-9]+', '#')", "swapped": "regex_replace(url, '^(https?)://([^/]+)', '${2}:$1')"}, "select page_id, regexp_replace(url, '[0-9]+', '#', 'g') as hidden, regexp_replace(url, '^(https?)://([^/]+)', '\\2:\\1', 'g') as swapped from pages"),
    "regex_counts": Projection("pages", ("page_id",), {"n": "regexp_count_substring(url, '[0-9]')", "all_": "size(regexp_match_all(url, '[0-9]+'))", "at": "regexp_strpos(url, '://')"}, "select page_id, len(regexp_extract_all(url, '[0-9]'))::bigint as n, len(regexp_extract_all(url, '[0-9]+'))::bigint as all_, strpos(url, '://')::bigint as at from pages"),
    "url_path_segment": Projection("pages", ("page_id",), {"segment": "url_path_segment(url, 0)", "strict": "url_path_segment(url, 0, 'require_authority')", "beyond": "url_path_segment(url, 99)", "odd": "url_path_segment(url, 0, 'none such')"}, "select page_id, regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]*)', 1) as segment, regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]*)', 1) as strict, null::varchar as beyond, null::varchar as odd from pages"),
    "url_query_param": Projection("pages", ("page_id",), {"source_": "url_query_param(url, 'utm_source')", "absent": "url_query_param(url, 'no_such')"}, "select page_id, case when regexp_matches(url, '[?&]utm_source=') then regexp_extract(url, '[?&]utm_source=([^&#]*)', 1) end as source_, null::varchar as absent from pages"),
    "casts": Projection(
        "orders",
        ("o_orderkey",),
        {"whole": "int(o_totalprice)", "wide": "double(o_orderkey)", "text": "string(o_orderkey)", "back": "int(string(o_orderkey))", "flag": "bool('true')", "tried": "try_or_else(int(o_orderstatus), -1)", "kind": "type(o_orderkey)", "same": "dyn(o_custkey)", "raw": "size(bytes(o_orderstatus))", "long_": "duration('1h30m') == duration('90m')"},
        "select o_orderkey, trunc(o_totalprice)::bigint as whole, o_orderkey::double as wide, o_orderkey::varchar as text, o_orderkey as back, true as flag, -1::bigint as tried, 'i64' as kind, o_custkey as same, strlen(o_orderstatus)::bigint as raw, true as long_ from orders",
    ),
    "unsigned": Projection("orders", ("o_orderkey",), {"big": "string(uint(o_custkey) * 3u)", "under": "try_or_else(string(uint(o_custkey - 100)), 'below')"}, "select o_orderkey, (o_custkey * 3)::varchar as big, case when o_custkey < 100 then 'below' else (o_custkey - 100)::varchar end as under from orders"),
    "timestamp_parts": Projection(
        "events",
        ("event_id",),
        {"y": "ts.getFullYear()", "mo": "ts.getMonth()", "d": "ts.getDate()", "d0": "ts.getDayOfMonth()", "wd": "ts.getDayOfWeek()", "yd": "ts.getDayOfYear()", "h": "ts.getHours()", "mi": "ts.getMinutes()", "s": "ts.getSeconds()", "ms": "ts.getMilliseconds()", "hour": "timestamp_extract(ts, 'hour')"},
        "select event_id, year(ts) as y, month(ts) - 1 as mo, day(ts) as d, day(ts) - 1 as d0, dayofweek(ts) as wd, dayofyear(ts) - 1 as yd, hour(ts) as h, minute(ts) as mi, second(ts) as s, millisecond(ts) % 1000 as ms, hour(ts) as hour from events",
    ),
    "timestamp_arithmetic": Projection(
        "orders",
        ("o_orderkey",),
        {"later": "o_orderdate + duration('36h')", "sooner": "o_orderdate - duration('30m')", "text": "datetime_format(o_orderdate, 'yyyy-MM-dd')", "after": "o_orderdate > timestamp('1995-01-01T00:00:00')", "read": "datetime_parse('2020-02-03 04:05:06')", "far": "o_orderdate - timestamp('1995-01-01T00:00:00') > duration('24h')", "doubled": "duration_multiply(duration('12h'), 2) == duration('24h')"},
        "select o_orderkey, o_orderdate + interval 36 hour as later, o_orderdate - interval 30 minute as sooner, strftime(o_orderdate, '%Y-%m-%d') as text, o_orderdate > timestamp '1995-01-01' as after, timestamp '2020-02-03 04:05:06' as read, o_orderdate - timestamp '1995-01-01' > interval 24 hour as far, true as doubled from orders",
    ),
    "round_temporal": Projection("events", ("event_id",), {"hour": "round_temporal(ts, 'hour')", "tens": "round_temporal(ts, '10 minutes')", "month": "round_calendar(ts, 'month')", "week": "round_calendar(ts, 'week')"}, "select event_id, date_trunc('hour', ts) as hour, time_bucket(interval '10 minutes', ts) as tens, date_trunc('month', ts)::timestamp as month, date_trunc('week', ts)::timestamp as week from events"),
    "conditional": Projection("part", ("p_partkey",), {"kind": "p_size > 40 ? 'large' : (p_size > 20 ? 'medium' : 'small')", "again": "case(p_size > 40, 'large', p_size > 20, 'medium', 'small')", "maybe": "p_size > 40 ? p_brand : null"}, "select p_partkey, case when p_size > 40 then 'large' when p_size > 20 then 'medium' else 'small' end as kind, case when p_size > 40 then 'large' when p_size > 20 then 'medium' else 'small' end as again, case when p_size > 40 then p_brand end as maybe from part"),
    "in_list": Projection("events", ("event_id", "event_type"), {}, "select event_id, event_type from events where event_type in ('click', 'view')", "event_type in ['click', 'view']"),
    "collections": Projection(
        "embeddings",
        ("vec_id",),
        {"first_": "embedding[0]", "n": "size(embedding)", "beyond": "try_or_else(embedding[1000], -9.0)", "pair": "[label, 7]", "looked": "{'a': label, 'b': 1}['a']", "keyed": "'b' in {'a': label, 'b': 1}", "least_": "list_sort(embedding)[0]", "field": "Point{x: label, y: 2}.x", "card": "list_cardinality(embedding)"},
        "select vec_id, embedding[1] as first_, len(embedding)::bigint as n, -9.0::double as beyond, [label::bigint, 7] as pair, label::bigint as looked, true as keyed, list_min(embedding) as least_, label as field, len(embedding)::bigint as card from embeddings",
    ),
    "quantifiers": Projection(
        "embeddings",
        ("vec_id",),
        {"some": "embedding.exists(x, x > 2.0)", "every": "embedding.all(x, x > -3.0)", "one": "embedding.exists_one(x, x > 2.0)", "kept": "size(embedding.filter(x, x > 0.0))", "doubled": "embedding.map(x, x * 2.0)[3]", "both": "size(embedding.map(x, x > 0.0, x + 1.0))", "nested": "embedding.exists(x, embedding.all(y, y <= x))"},
        "select vec_id, len(list_filter(embedding, lambda x: x > 2.0)) > 0 as some, len(list_filter(embedding, lambda x: not x > -3.0)) = 0 as every, len(list_filter(embedding, lambda x: x > 2.0)) = 1 as one, len(list_filter(embedding, lambda x: x > 0.0))::bigint as kept, embedding[4]::double * 2.0 as doubled, len(list_filter(embedding, lambda x: x > 0.0))::bigint as both, true as nested from embeddings",
    ),
    "json": Projection(
        "events",
        ("event_id",),
        {"text": "json_extract_string(props, '$.k')", "object": "json_extract_string(props, '$')", "number": "int(json_extract(props, '$.k'))", "parsed": "int(json_parse(props).k)", "list": "json_stringify([user_id, 1])", "quoted": "json_stringify(event_type)", "bad": "try_or_else(int(json_parse(event_type).k), -1)"},
        "select event_id, json_extract_string(props, '$.k') as text, null::varchar as object, cast(json_extract(props, '$.k') as bigint) as number, cast(json_extract(props, '$.k') as bigint) as parsed, '[' || user_id || ',1]' as list, '\"' || event_type || '\"' as quoted, -1::bigint as bad from events",
    ),
    "cidr": Projection(
        "orders",
        ("o_orderkey",),
        {"inside": "cidr_contains(ip, '10.4.0.0/16')", "short": "cidr_contains(ip, '10/8')", "any_": "cidr_match(ip, ['10.1/16', '10.2.0.0/16', '10.3.3.0/24'])", "number": "ip_to_int(ip)", "back": "int_to_ip(ip_to_int(ip))", "bad": "is_null(ip_to_int('10.0.0.256'))"},
        f"with t as (select o_orderkey, o_custkey % 256 as b, o_orderkey % 7 as c, {SQL_IP} as ip from orders) select o_orderkey, b = 4 as inside, true as short, b in (1, 2) or (b = 3 and c = 3) as any_, 167772160 + b * 65536 + c * 256 + 1 as number, ip as back, true as bad from t",
        prepare=IP,
    ),
}


# --- what is not a projection -----------------------------------------------------------------


def cast_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text compared with a number, which only the aggressive mode converts."""
    rows = read(spark, sf_dir, "orders").withColumn("text", F.col("o_custkey").cast("string"))
    return Engine(mode=CastMode.AGGRESSIVE).select(rows, keep=("o_orderkey",), big="text > 500", total="o_custkey + text")


def aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregate(
        Engine(), read(spark, sf_dir, "events"), {"event_type": "event_type"},
        n=Aggregate("count"), n_value=Aggregate("count", "value"), total=Aggregate("sum", "user_id"), mean=Aggregate("avg", "value"), low=Aggregate("min", "value"), high=Aggregate("max", "value"), middle=Aggregate("median", "value"),
        p90=Aggregate("percentile", "value", at=0.9), users=Aggregate("count_distinct", "user_id"), spread=Aggregate("std_dev", "value"), var_=Aggregate("variance", "value"),
    )
    return out.select("event_type", "n", "n_value", "total", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high", "middle", "p90")), "users", *(F.round(c, 4).alias(c) for c in ("spread", "var_")))


def ordered_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = "Key{t: ts, i: event_id}"
    return aggregate(Engine(), read(spark, sf_dir, "events"), {"user_id": "user_id"}, first_=Aggregate("first", "event_type", by), last_=Aggregate("last", "event_type", by), second_=Aggregate("nth_value", "event_id", by, 2))


def product_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(Engine(), read(spark, sf_dir, "lineitem"), {"l_orderkey": "l_orderkey"}, product_=Aggregate("product", "l_linenumber"))


def grouped_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a filtered aggregate over computed groups."""
    engine = Engine()
    rows = engine.filter(read(spark, sf_dir, "lineitem"), "l_shipdate <= timestamp('1998-09-02T00:00:00') && l_discount < 0.09")
    out = aggregate(engine, rows, {"l_returnflag": "l_returnflag", "bulk": "l_quantity > 25.0 ? 'large' : 'small'"}, revenue=Aggregate("sum", "l_extendedprice * (1.0 - l_discount)"), n=Aggregate("count"))
    return out.select("l_returnflag", "bulk", F.round("revenue", 2).alias("revenue"), "n")


def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    engine = Engine(enrichments={"nation": (nation, ["c_nationkey"])})
    return engine.select(read(spark, sf_dir, "customer"), keep=("c_custkey",), name="_.enrichments.nation.n_name", far="_.enrichments.nation.n_regionkey > 2")


UDFS = """
namespace: com.example.text
version: "1"
functions:
  - id: tail
    cel: tail
    params: [{ name: s, type: string }, { name: n, type: i64, nullable: true }]
    return_type: string
  - id: halved
    cel: halved
    params: [{ name: x, type: i64 }]
    return_type: i64
    body: "x / 2"
  - id: parts
    cel: parts
    params: [{ name: s, type: string }]
    return_type: { struct: [{ name: head, type: string }, { name: size, type: i64, nullable: true }] }
"""


def udfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = Registry()
    registry.load(UDFS, {"tail": lambda s, n: s[-(n or 1) :], "parts": lambda s: {"head": s[:1], "size": len(s)}})
    engine = Engine(registry, [Import("com.example.text", "1", "tail"), Import("com.example.text", "1", "halved", "half"), Import("com.example.text", "1", "parts")])
    return engine.select(read(spark, sf_dir, "nation"), keep=("n_nationkey",), end="tail(n_name, 3)", last_="tail(n_name)", half_="half(int(n_nationkey))", size_="parts(n_name).size")


LINE_RULES = Rules.of({"l_quantity": [Rule("min", 5.0), Rule("max", 45.0, inclusive=False)], "l_discount": [Rule("max", 0.08)], "l_returnflag": [Rule("one_of", ["A", "N"]), Rule("non_empty")], "l_linestatus": [Rule("pattern", "[FO]"), Rule("max_len", 1), Rule("min_len", 1)]}, [Rule("expr", "l_extendedprice > 1000.0 || l_quantity > 10.0")])


def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checked(read(spark, sf_dir, "lineitem"), rules=LINE_RULES)
    return rows.select("l_orderkey", "l_linenumber", F.array_join(F.transform("violations", lambda v: F.concat_ws(":", v.getField("path"), v.getField("rule"))), ",").alias("broken"))


ORDER_TYPE = """
struct:
  - { name: o_orderkey, type: i64 }
  - { name: o_custkey, type: u16 }
  - { name: o_orderstatus, type: { enum: [F, O] } }
  - { name: o_comment, type: string, nullable: true }
"""


def conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checked(read(spark, sf_dir, "orders").withColumn("o_custkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey") * 100 - 5000)), TypeBook().parse(ORDER_TYPE))
    return rows.select("o_orderkey", F.array_join(F.transform("violations", lambda v: v.getField("path")), ",").alias("mismatched"))


def ingest_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each kind pass, are refused for their structure, or are held back for a rule."""
    rows = read(spark, sf_dir, "events").withColumn("user_id", F.when(F.col("event_id") % 10 != 0, F.col("user_id")))
    schema = TypeBook().parse("{struct: [{name: event_id, type: i64}, {name: user_id, type: i64}, {name: value, type: f64}]}")
    parts = split(rows, schema, Rules.of({"value": [Rule("max", 50.0)]}))
    every = [p.select("event_type", F.lit(n).alias("outcome")) for n, p in (("accepted", parts.accepted), ("rejected", parts.rejected), ("quarantined", parts.quarantined))]
    return every[0].union(every[1]).union(every[2]).groupBy("event_type", "outcome").agg(F.count("*").alias("n"))


def json_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = TypeBook().parse("{struct: [{name: k, type: i64}, {name: missing, type: string}]}")
    rows = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("props")).otherwise(F.lit("{oops")).alias("props"))
    return read_events(rows, "props", schema, defaults=True)


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowed(Engine(), read(spark, sf_dir, "events"), "ts", "10 minutes", {"n": Aggregate("count"), "total": Aggregate("sum", "value")})
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", F.round("total", 2).alias("total"))


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowed(Engine(), read(spark, sf_dir, "events"), "ts", "20 minutes", {"n": Aggregate("count")}, {"event_type": "event_type"}, slide="10 minutes")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowed(Engine(), read(spark, sf_dir, "events"), "ts", "30 minutes", {"n": Aggregate("count")}, {"user_id": "user_id"}, gap=True)
    return out.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


def time_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", bucket("ts", 3_600_000, 877_000).cast("timestamp_ntz").alias("start"))


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and orders as entities: a cut, and what all orders reach."""
    import uuid

    from lintel.sources.epochs import EpochStore, joined

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.checkpoints"
    store = EpochStore(spark, f"{shared}/epochs-{uuid.uuid4().hex}")
    store.create_types(["customer", "order"])
    store.put_type_versions(spark.createDataFrame([("customer", b"1", "t"), ("order", b"1", "t"), ("customer", b"2", "t")], "type_id string, content binary, tag string"))
    store.add_edges("type", spark.createDataFrame([("order", 1, "customer", None)], "from_id string, from_ver bigint, to_id string, to_ver bigint"))
    orders = read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("o"), F.concat(F.lit("c"), "o_custkey").alias("c"))
    customers = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("c"))
    none = F.lit(None).cast("bigint").alias("type_version_id")
    store.create_entities(customers.select(F.col("c").alias("id"), F.lit("customer").alias("type_id")))
    store.create_entities(orders.select(F.col("o").alias("id"), F.lit("order").alias("type_id")))
    store.put_versions(customers.select(F.col("c").alias("entity_id"), F.lit(b"a").alias("content"), none))
    store.put_versions(orders.select(F.col("o").alias("entity_id"), F.lit(b"a").alias("content"), none))
    store.put_versions(customers.filter("substr(c, 2) % 2 = 0").select(F.col("c").alias("entity_id"), F.lit(b"b").alias("content"), none))
    store.add_edges("entity", joined(orders, customers, "c").select(F.col("o").alias("from_id"), F.lit(1).cast("long").alias("from_ver"), F.col("c").alias("to_id"), F.lit(None).cast("long").alias("to_ver")))
    epoch = store.cut_epoch()
    return store.closure(epoch, orders.select("o")).entities


OTHERS: dict[str, tuple[Query, str | None]] = {
    "cast_modes": (cast_modes, "select o_orderkey, o_custkey > 500 as big, o_custkey * 2 as total from orders"),
    "aggregates": (aggregates, "select event_type, count(*) as n, count(value) as n_value, sum(user_id)::bigint as total, round(avg(value), 6) as mean, round(min(value), 6) as low, round(max(value), 6) as high, round(median(value), 6) as middle, round(quantile_cont(value, 0.9), 6) as p90, count(distinct user_id) as users, round(stddev_samp(value), 4) as spread, round(var_samp(value), 4) as var_ from events group by event_type"),
    "ordered_aggregates": (ordered_aggregates, "select user_id, arg_min(event_type, {'t': ts, 'i': event_id}) as first_, arg_max(event_type, {'t': ts, 'i': event_id}) as last_, list(event_id order by ts, event_id)[2] as second_ from events group by user_id"),
    "product_aggregate": (product_aggregate, "select l_orderkey, product(l_linenumber) as product_ from lineitem group by l_orderkey"),
    "grouped_expressions": (grouped_expressions, "select l_returnflag, case when l_quantity > 25 then 'large' else 'small' end as bulk, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' and l_discount < 0.09 group by all"),
    "enrichment": (enrichment, "select c_custkey, n_name as name, n_regionkey > 2 as far from customer left join nation on c_nationkey = n_nationkey"),
    "udfs": (udfs, "select n_nationkey, right(n_name, 3) as end, right(n_name, 1) as last_, (n_nationkey // 2)::bigint as half_, length(n_name)::bigint as size_ from nation"),
    "validation": (
        validation,
        "select l_orderkey, l_linenumber, array_to_string(list_filter([case when l_quantity < 5 then 'l_quantity:min' end, case when l_quantity >= 45 then 'l_quantity:max' end, case when l_discount > 0.08 then 'l_discount:max' end, case when l_returnflag not in ('A', 'N') then 'l_returnflag:one_of' end, case when not regexp_full_match(l_linestatus, '[FO]') then 'l_linestatus:pattern' end, case when not (l_extendedprice > 1000 or l_quantity > 10) then '(root):expr' end], lambda x: x is not null), ',') as broken from lineitem",
    ),
    "conformance": (conformance, "select o_orderkey, array_to_string(list_filter([case when o_orderkey % 50 = 0 or not o_custkey * 100 - 5000 between 0 and 65535 then 'o_custkey' end, case when o_orderstatus not in ('F', 'O') then 'o_orderstatus' end], lambda x: x is not null), ',') as mismatched from orders"),
    "ingest_split": (ingest_split, "select event_type, case when event_id % 10 = 0 then 'rejected' when value > 50 then 'quarantined' else 'accepted' end as outcome, count(*) as n from events group by all"),
    "json_ingest": (json_ingest, "select event_id, case when event_id % 7 <> 0 then cast(json_extract(props, '$.k') as bigint) end as k, case when event_id % 7 <> 0 then '' end as missing, event_id % 7 = 0 as malformed from events"),
    "tumbling": (tumbling, "select time_bucket(interval '10 minutes', ts) as window_start, count(*) as n, round(sum(value), 2) as total from events group by 1"),
    "sliding": (sliding, "select b - to_minutes(k * 10) as window_start, event_type, count(*) as n from (select time_bucket(interval '10 minutes', ts) as b, event_type, unnest([0, 1]) as k from events) group by 1, 2"),
    "sessions": (sessions, "with s as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end as new from events window w as (partition by user_id order by ts)), g as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from s) select user_id, min(ts) as window_start, count(*) as n from g group by user_id, k"),
    "time_buckets": (time_buckets, "select event_id, time_bucket(interval '1 hour', ts - interval 877 second) + interval 877 second as start from events"),
    "epochs": (epochs, "select 'o' || o_orderkey as entity_id, 1::bigint as version_id from orders union select 'c' || c_custkey, case when c_custkey % 2 = 0 then 2 else 1 end from customer where c_custkey in (select o_custkey from orders)"),
}


PROJECTIONS |= {
    "truth_tests": Projection(
        "orders",
        ("o_orderkey",),
        {"yes": "is_true(f)", "not_yes": "is_not_true(f)", "no": "is_false(f)", "not_no": "is_not_false(f)", "other": "nullif(o_orderstatus, 'O')", "low": "least_skip_null(n, 5)", "high": "greatest_skip_null(n, 5)"},
        "with t as (select *, case when o_custkey % 3 = 0 then null else o_custkey % 3 = 1 end as f, nullif(o_custkey % 10, 3) as n from orders) select o_orderkey, f is not distinct from true as yes, f is distinct from true as not_yes, f is not distinct from false as no, f is distinct from false as not_no, nullif(o_orderstatus, 'O') as other, least(coalesce(n, 5), 5) as low, greatest(coalesce(n, 5), 5) as high from t",
        prepare="case when o_custkey % 3 = 0 then null else o_custkey % 3 = 1 end as f ; nullif(o_custkey % 10, 3) as n",
    ),
    "trigonometry": Projection(
        "part",
        ("p_partkey",),
        {op: f"int(round({op}({arg}) * 10000.0))" for op, arg in {"sin": "x", "cos": "x", "tan": "x / 40.0", "asin": "x / 60.0", "acos": "x / 60.0", "atan": "x", "sinh": "x / 20.0", "cosh": "x / 20.0", "tanh": "x / 20.0", "asinh": "x", "acosh": "x + 1.0", "atanh": "x / 60.0", "radians": "x", "degrees": "x", "log2": "x + 1.0", "log1p": "x"}.items()} | {"atan2": "int(round(atan2(x, 7.0) * 10000.0))", "logb": "int(round(logb(x + 2.0, 3.0) * 10000.0))", "fact": "factorial(p_size % 10)"},
        "with t as (select p_partkey, p_size, p_size::double as x from part) select p_partkey, "
        + ", ".join(f"round({op}({arg}) * 10000)::bigint as {op}" for op, arg in {"sin": "x", "cos": "x", "tan": "x / 40", "asin": "x / 60", "acos": "x / 60", "atan": "x", "sinh": "x / 20", "cosh": "x / 20", "tanh": "x / 20", "asinh": "x", "acosh": "x + 1", "atanh": "x / 60", "radians": "x", "degrees": "x"}.items())
        + ", round(log2(x + 1) * 10000)::bigint as log2, round(ln(1 + x) * 10000)::bigint as log1p, round(atan2(x, 7) * 10000)::bigint as atan2, round(ln(x + 2) / ln(3) * 10000)::bigint as logb, factorial((p_size % 10)::integer)::bigint as fact from t",
        prepare="double(p_size) as x",
    ),
    "bits": Projection(
        "orders",
        ("o_orderkey",),
        {"not_": "bitwise_not(o_custkey)", "and_": "bitwise_and(o_custkey, o_orderkey)", "or_": "bitwise_or(o_custkey, o_orderkey)", "xor_": "bitwise_xor(o_custkey, 255)", "left_": "shift_left(o_custkey, 3)", "right_": "shift_right(o_custkey, 2)", "right_u": "shift_right_unsigned(o_custkey, 2)"},
        "select o_orderkey, ~o_custkey as not_, o_custkey & o_orderkey as and_, o_custkey | o_orderkey as or_, xor(o_custkey, 255) as xor_, o_custkey << 3 as left_, o_custkey >> 2 as right_, o_custkey >> 2 as right_u from orders",
    ),
    "string_forms": Projection(
        "orders",
        ("o_orderkey",),
        {"twice": "repeat(o_orderstatus, 2)", "back": "reverse(o_orderpriority)", "cut": "replace_slice(o_orderpriority, 2, 3, '**')", "swapped": "swapcase(o_orderpriority)", "cap": "capitalize(lower(o_orderpriority))", "titled": "title(w)", "init": "initcap(w)", "bits_": "bit_length(o_orderpriority)", "l": "lpad(o_orderpriority, 12, '.')", "r": "rpad(o_orderpriority, 12)", "mid": "center(o_orderstatus, 4, '-')", "like_": "like(o_orderpriority, '_-H%')"},
        "select o_orderkey, repeat(o_orderstatus, 2) as twice, reverse(o_orderpriority) as back, left(o_orderpriority, 1) || '**' || substr(o_orderpriority, 5) as cut, case when o_orderpriority = upper(o_orderpriority) then lower(o_orderpriority) end as swapped, lower(o_orderpriority) as cap, 'Some ' || case o_orderstatus when 'F' then 'F' when 'O' then 'O' else 'P' end || ' here' as titled, 'Some ' || o_orderstatus || ' here' as init, bit_length(o_orderpriority)::bigint as bits_, lpad(o_orderpriority, 12, '.') as l, rpad(o_orderpriority, 12, ' ') as r, '-' || o_orderstatus || '--' as mid, o_orderpriority like '_-H%' as like_ from orders".replace("' here'", "' Here'"),
        prepare="concat('some ', lower(o_orderstatus), ' here') as w",
    ),
    "times_read": Projection(
        "events",
        ("event_id",),
        {"day": "strptime_date('2024-02-29 x', \"yyyy-MM-dd 'x'\")", "time_": "strptime_time('10:20:30', 'HH:mm:ss') == duration('10h20m30s')", "leap": "extract_boolean(ts, 'is_leap_year')", "zoned": "assume_timezone(ts, 'America/New_York').getHours()", "past": "ts < current_timestamp()", "parsed": "json_stringify(json_parse_struct(props, 'k bigint'))"},
        "select event_id, date '2024-02-29' as day, true as time_, year(ts) % 4 = 0 as leap, hour(timezone('America/New_York', timezone('UTC', ts))) as zoned, true as past, '{\"k\":' || json_extract_string(props, '$.k') || '}' as parsed from events",
    ),
    "url_forms": Projection(
        "orders",
        ("o_orderkey",),
        {"blank": "url_path_segment(u, 0)", "name": "url_query_param(u, 'x_y')", "bare": "url_query_param(u, 'a')", "odd": "url_query_param(u, 'z')", "up": "url_path_segment(u, 1)", "mail": "url_path_segment('mailto:a@b/c', 0)", "ref": "url_path_segment('/foo/bar.php?baz=quux', 1)", "no_host": "url_path_segment('http:///', 0, 'require_authority')"},
        "select o_orderkey, 'a%20b|' || o_custkey as blank, '1 ' || o_custkey as name, '' as bare, '%zz' as odd, 'é'.replace('é', '%C3%A9') as up, null::varchar as mail, 'bar.php' as ref, null::varchar as no_host from orders",
        prepare="concat('HTTPS://u@h:80/./x/../a b|', o_custkey, '/é?x%5Fy=1+', o_custkey, '&a&z=%zz#f') as u",
    ),
    "addresses": Projection(
        "orders",
        ("o_orderkey",),
        {"net": "cidr_contains(six, '2001:db8::/32')", "host": "cidr_contains(six, '2001:db8::7/128')", "mapped": "cidr_contains(four, '10.0.0.0/8')", "some": "cidr_match(six, ['fe80::/10', '2001:db8:0:0::/125', '10/8'])", "given": "cidr_contains(six, blk)", "none": "cidr_contains('2001::db8::1', '::/0')"},
        "select o_orderkey, true as net, o_custkey % 16 = 7 as host, o_custkey % 2 = 0 as mapped, o_custkey % 16 < 8 as some, o_custkey % 16 < 4 as given, null::boolean as none from orders",
        prepare="concat('2001:DB8::', lower(hex(o_custkey % 16))) as six ; concat('::ffff:', if(o_custkey % 2 = 0, '10', '11'), '.1.2.3') as four ; concat('2001:db8::/', if(o_orderkey >= 0, '126', '0')) as blk",
    ),
}


def more_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregate(Engine(), read(spark, sf_dir, "orders"), {"status": "o_orderstatus"}, every=Aggregate("bool_and_agg", "o_totalprice > 2000.0"), some=Aggregate("bool_or_agg", "o_totalprice > 2000.0"), total=Aggregate("sum0", "o_custkey"), both=Aggregate("corr", "double(o_custkey)", other="o_totalprice"), most=Aggregate("mode", "o_orderpriority"), any_=Aggregate("any_value", "o_orderstatus"))
    return out.withColumn("both", F.round("both", 6))


def strings_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(Engine(), read(spark, sf_dir, "nation"), {"n_regionkey": "n_regionkey"}, names=Aggregate("string_agg", "n_name", by="n_nationkey", at="; "))


def window_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    out = over(Engine(), rows, ["o_custkey"], ["o_orderstatus"], r=Over("rank"), d=Over("dense_rank"), p=Over("percent_rank"), c=Over("cume_dist"))
    out = over(Engine(), out, ["o_custkey"], ["-o_orderkey"], n=Over("row_number"), q=Over("ntile", n=3), after=Over("lead", "o_totalprice"), before=Over("lag", "o_orderkey", n=2))
    return out.select("o_orderkey", "r", "d", F.round("p", 6).alias("p"), F.round("c", 6).alias("c"), "n", "q", "after", "before")


def listed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses against a table of blocks, one for each customer."""
    from lintel.functions.net import in_listed

    blocks = read(spark, sf_dir, "customer").select(F.concat(F.lit("10."), (F.col("c_custkey") % 256).cast("string"), F.lit("."), (F.col("c_custkey") % 7).cast("string"), F.lit("/"), F.when(F.col("c_custkey") % 3 == 0, F.lit("24")).otherwise(F.lit("32"))).alias("b"))
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey", IP)
    return in_listed(rows, "ip", blocks, "b").select("o_orderkey", "listed")


OTHERS |= {
    "more_aggregates": (more_aggregates, "with m as (select o_orderstatus, o_orderpriority, row_number() over (partition by o_orderstatus order by count(*) desc, o_orderpriority) as k from orders group by o_orderstatus, o_orderpriority) select o.o_orderstatus as status, bool_and(o_totalprice > 2000) as every, bool_or(o_totalprice > 2000) as some, sum(o_custkey)::bigint as total, round(corr(o_custkey::double, o_totalprice), 6) as both, min(m.o_orderpriority) as most, min(o.o_orderstatus) as any_ from orders o join m on m.o_orderstatus = o.o_orderstatus and k = 1 group by 1"),
    "strings_together": (strings_together, "select n_regionkey, string_agg(n_name, '; ' order by n_nationkey) as names from nation group by 1"),
    "window_functions": (window_functions, "select o_orderkey, rank() over s as r, dense_rank() over s as d, round(percent_rank() over s, 6) as p, round(cume_dist() over s, 6) as c, row_number() over k as n, ntile(3) over k as q, lead(o_totalprice) over k as after, lag(o_orderkey, 2) over k as before from orders window s as (partition by o_custkey order by o_orderstatus), k as (partition by o_custkey order by o_orderkey desc)"),
    "listed_addresses": (listed_addresses, "with b as (select distinct c_custkey % 256 as x, c_custkey % 7 as y from customer where c_custkey % 3 = 0) select o_orderkey, b.x is not null as listed from orders left join b on b.x = o_custkey % 256 and b.y = o_orderkey % 7"),
}


def queries() -> dict[str, Query]:
    return {**PROJECTIONS, **{name: query for name, (query, _) in OTHERS.items()}}


def oracle_sql() -> dict[str, str]:
    return {**{name: p.sql for name, p in PROJECTIONS.items()}, **{name: sql for name, (_, sql) in OTHERS.items() if sql}}
