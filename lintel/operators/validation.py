"""Two tiers of checks over rows: does a value have its type, and does it obey the rules.

Both compile to one column of violations, structs of tier, path, rule and message, so any number
of checks costs one pass and no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintel.engine import Engine
from lintel.functions.cel import parse
from lintel.functions.lower import Lowering
from lintel.ir import Name, Var, rewrite
from lintel.plans.typecheck import Checker, Schema
from lintel.types import BOOL, FLOATS, Field, ValueType, from_spark, struct, to_spark

VIOLATION = "struct<tier:string,path:string,rule:string,message:string>"
Path = tuple[str | int, ...]


class RuleError(ValueError):
    """A rule that cannot apply to its path's type."""


def path(text: str) -> Path:
    """addr.lines[0] as its steps."""
    steps = tuple(int(i) if i else n for n, i in re.findall(r"([^.\[\]]+)(?![^\[]*\])|\[(\d+)\]", text))
    if text not in ("", "(root)") and shown(steps) != text:
        raise RuleError(f"no path: {text}")
    return () if text in ("", "(root)") else steps


def shown(steps: Path) -> str:
    out = "".join(f"[{s}]" if isinstance(s, int) else f".{s}" for s in steps)
    return out.removeprefix(".") or "(root)"


def violation(when: Column, tier: str, where: Column | str, rule: str, message: Column | str) -> Column:
    """A violation where the condition holds, null elsewhere."""
    col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(tier).alias("tier"), col(where).alias("path"), F.lit(rule).alias("rule"), col(message).alias("message")))


def gathered(single: list[Column], lists: Iterable[Column] = ()) -> Column:
    empty = F.array().cast(f"array<{VIOLATION}>")
    own = F.filter(F.array(*single).cast(f"array<{VIOLATION}>"), lambda v: v.isNotNull()) if single else empty
    lists = [F.coalesce(x, empty) for x in lists]
    return F.concat(own, *lists) if lists else own


# --- structure --------------------------------------------------------------------------------

UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
RANGES = {"u8": (0, 255), "u16": (0, 65535), "u32": (0, 2**32 - 1), "u64": (0, 2**64 - 1)}


def structure(c: Column, has: T.DataType, t: ValueType, where: Column | None = None, nullable: bool = False) -> Column:
    """All mismatches of a column of Spark type `has` with a value type, depth first.

    A struct's fields are found by name; fields beyond the type's are tolerated, and a missing one
    is a mismatch unless it may be null. An enum is its label or its place.
    """
    where = F.lit("") if where is None else where
    here = F.when(where == "", "(root)").otherwise(where)
    bad = lambda when, message: violation(when, "conformance", here, "type", message)
    single = [] if nullable else [bad(c.isNull(), f"null for {t}")]
    lists: list[Column] = []
    expected = to_spark(t)
    misfit = bad(c.isNotNull(), f"{has.simpleString()} for {t}")
    step = lambda name: F.when(where == "", F.lit(name)).otherwise(F.concat(where, F.lit(f".{name}")))
    match t.kind:
        case "struct":
            if not isinstance(has, T.StructType):
                return gathered([*single, misfit])
            there = {f.name: f.dataType for f in has.fields}
            for f in t.fields:
                if f.name in there:
                    lists.append(F.when(c.isNotNull(), structure(c.getField(f.name), there[f.name], f.type, step(f.name), f.nullable)))
                elif not f.nullable:
                    single.append(violation(c.isNotNull(), "conformance", step(f.name), "type", f"missing {f.type}"))
        case "array":
            if not isinstance(has, T.ArrayType):
                return gathered([*single, misfit])
            lists.append(F.flatten(F.transform(c, lambda x, i: structure(x, has.elementType, t.element, F.concat(where, F.lit("["), i.cast("string"), F.lit("]")), t.nullable))))
        case "map":
            if not isinstance(has, T.MapType):
                return gathered([*single, misfit])
            # values are numbered in the order of their keys
            entries = F.array_sort(F.map_entries(c))
            lists.append(F.flatten(F.transform(entries, lambda e, i: structure(e.getField("value"), has.valueType, t.element, F.concat(where, F.lit("["), i.cast("string"), F.lit("]")), t.nullable))))
            lists.append(F.flatten(F.transform(entries, lambda e, i: structure(e.getField("key"), has.keyType, t.key, F.concat(where, F.lit("["), i.cast("string"), F.lit("].key"))))))
        case "enum":
            if isinstance(has, T.StringType):
                single.append(bad(~c.isin(list(t.labels)) if t.labels else F.lit(False), F.concat(F.lit("no label: "), c)))
            elif isinstance(has, (T.IntegralType,)):
                single.append(bad(~c.between(0, len(t.labels) - 1) if t.labels else F.lit(False), F.concat(F.lit("no label: "), c.cast("string"))))
            else:
                single.append(misfit)
        case _ if t.kind in RANGES:
            low, high = RANGES[t.kind]
            exact = isinstance(has, T.IntegralType) or isinstance(has, T.DecimalType) and has.scale == 0
            single.append(bad(~c.cast("decimal(38,0)").between(F.lit(low), F.lit(str(high)).cast("decimal(38,0)")), F.concat(F.lit(f"out of range for {t}: "), c.cast("string"))) if exact else misfit)
        case "entity_ref" if not t.pinnable:
            lists.append(structure(c, has, t.key, where, True))
        case "uuid":
            single.append(bad(~c.rlike(UUID), F.concat(F.lit("no uuid: "), c)) if isinstance(has, T.StringType) else misfit)
        case "string" | "fixedchar":
            if not isinstance(has, T.StringType):
                return gathered([*single, misfit])
            if t.precision:
                single.append(bad(F.length(c) > t.precision, f"longer than {t.precision}"))
        case _:
            fits = has == expected or isinstance(has, (T.TimestampType, T.TimestampNTZType)) and t.kind == "timestamp" or isinstance(has, T.StringType) and isinstance(expected, T.StringType) or isinstance(has, T.DayTimeIntervalType) and t.kind == "duration"
            if not fits and not isinstance(expected, T.NullType):
                single.append(misfit)
    return gathered(single, lists)


def first_mismatch(violations: Column) -> Column:
    """The first of the violations as text, or null."""
    one = F.get(violations, 0)
    return F.when(F.size(violations) > 0, F.concat(one.getField("rule"), F.lit(" at "), one.getField("path"), F.lit(": "), one.getField("message")))


# --- rules ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """kind: min, max, min_len, max_len, non_empty, pattern, one_of or expr. search: a pattern may match anywhere."""

    kind: str
    value: Any = None
    inclusive: bool = True
    search: bool = False


@dataclass(frozen=True)
class Rules:
    """Rules by path, and rules of the whole row; both only ever narrow what passes."""

    fields: Mapping[Path, tuple[Rule, ...]] = field(default_factory=dict)
    entity: tuple[Rule, ...] = ()

    @classmethod
    def of(cls, fields: Mapping[str, Iterable[Rule]] | None = None, entity: Iterable[Rule] = ()) -> Rules:
        return cls({path(k): tuple(v) for k, v in (fields or {}).items()}, tuple(entity))

    def __and__(self, other: Rules) -> Rules:
        both = {p: self.fields.get(p, ()) + other.fields.get(p, ()) for p in [*self.fields, *(p for p in other.fields if p not in self.fields)]}
        return Rules(both, self.entity + other.entity)

    def prefixed(self, at: str) -> Rules:
        """The rules for where their row is part of a larger one: all become rules of paths."""
        base = path(at)
        fields = {base + p: r for p, r in self.fields.items()}
        if self.entity:
            fields[base] = fields.get(base, ()) + self.entity
        return Rules(fields)


def reached(c: Column, t: ValueType, steps: Path) -> tuple[Column, ValueType] | None:
    """The column at a path and its type; null where something on the way is; None if the type has no such path."""
    for s in steps:
        if isinstance(s, str) and t.kind == "struct" and (found := [f for f in t.fields if f.name == s]):
            c, t = c.getField(s), found[0].type
        elif isinstance(s, int) and t.kind == "array":
            c, t = F.get(c, s), t.element
        elif isinstance(s, int) and t.kind == "map":
            c, t = F.get(F.array_sort(F.map_entries(c)), s).getField("value"), t.element
        else:
            return None
    return c, t


LENGTHS = {"string": F.length, "fixedchar": F.length, "clob": F.length, "blob": F.octet_length, "array": F.size, "map": F.size}


def broken(rule: Rule, c: Column, t: ValueType, engine: Engine) -> tuple[Column, str]:
    """(condition under which the rule is violated, message); nulls break no rule but an expression's."""
    real = ~F.isnan(c) if t.kind in FLOATS else F.lit(True)
    if rule.kind in ("min", "max"):
        if t.kind in ("bool", "uuid", "ipv4", "ipv6", "array", "map", "struct", "enum"):
            raise RuleError(f"{t} has no order for {rule.kind}")
        c, value = (c.getField("ts"), rule.value) if t.zone == "utc_offset" else (c, rule.value)
        value = F.lit(value)
        fails = {("min", True): c < value, ("min", False): c <= value, ("max", True): c > value, ("max", False): c >= value}[rule.kind, rule.inclusive]
        return fails & real, f"{'below' if rule.kind == 'min' else 'above'} {rule.value}" + " or equal" * (not rule.inclusive)
    if rule.kind in ("min_len", "max_len", "non_empty"):
        if t.kind not in LENGTHS:
            raise RuleError(f"{t} has no length")
        n = LENGTHS[t.kind](c)
        if rule.kind == "non_empty":
            return n == 0, "empty"
        return (n < rule.value, f"shorter than {rule.value}") if rule.kind == "min_len" else (n > rule.value, f"longer than {rule.value}")
    if rule.kind == "pattern":
        try:
            re.compile(rule.value)
        except re.error as error:
            return c.isNotNull(), f"no pattern: {error}"
        return ~c.rlike(rule.value if rule.search else f"^(?:{rule.value})\\z"), f"does not match {rule.value}"
    if rule.kind == "one_of":
        return ~c.isin(list(rule.value)), f"none of {', '.join(map(str, rule.value))}"
    if rule.kind == "expr":
        # the value's fields are in scope, and the value itself as `this`
        tree = parse(rule.value).expr
        names = {f.name: f for f in t.fields}
        tree = rewrite(tree, lambda n: Var(n.name) if isinstance(n, Name) and (n.name in names or n.name == "this") else n)
        scope = {n: (f.type, True) for n, f in names.items()} | {"this": (t, True)}
        typed = Checker(Schema(()), engine.mode).check(tree, scope)
        if typed.type != BOOL:
            raise RuleError(f"a rule is a condition, not {typed.type}: {rule.value}")
        pair = Lowering().lower(typed, {n: c.getField(n) for n in names} | {"this": c})
        fails = F.coalesce(~pair.value, F.lit(False))
        return (fails if pair.error is None else fails | pair.error), f"not so: {rule.value}"
    raise RuleError(f"no rule {rule.kind}")


def broken_rules(c: Column, t: ValueType, rules: Rules, engine: Engine | None = None) -> Column:
    """All violations of the rules; rules of a path that the type does not have are skipped."""
    engine, out = engine or Engine(), []
    for steps, own in [*rules.fields.items(), ((), rules.entity)]:
        found = reached(c, t, steps)
        if found is not None:
            for rule in own:
                when, message = broken(rule, *found, engine)
                out.append(violation(when, "rule", shown(steps), rule.kind, message))
    return gathered(out)


# --- rows -------------------------------------------------------------------------------------


def row_of(df: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def checked(df: DataFrame, t: ValueType | None = None, rules: Rules | None = None, name: str = "violations") -> DataFrame:
    """df and a column of its violations, of structure first."""
    t = t or struct(*(Field(f.name, f.type, True) for f in from_spark(df.schema).fields))
    row = row_of(df)
    parts = [structure(row, df.schema, t), *([broken_rules(row, from_spark(df.schema), rules)] if rules else [])]
    return df.withColumn(name, F.concat(*parts))


def effects(violations: Column) -> Column:
    """What a row's violations come to: may_not_conform, may_violate_rule."""
    tiers = F.transform(violations, lambda v: v.getField("tier"))
    return F.filter(F.array(F.when(F.array_contains(tiers, "conformance"), F.lit("may_not_conform")), F.when(F.array_contains(tiers, "rule"), F.lit("may_violate_rule"))), lambda x: x.isNotNull())


@dataclass
class Split:
    """Rows that pass; rows of the wrong structure; rows of the right structure that break a rule."""

    accepted: DataFrame
    rejected: DataFrame
    quarantined: DataFrame


def split(df: DataFrame, t: ValueType | None = None, rules: Rules | None = None) -> Split:
    every = checked(df, t, rules)
    tiers = F.transform("violations", lambda v: v.getField("tier"))
    clean, wrong = F.size("violations") == 0, F.array_contains(tiers, "conformance")
    return Split(every.filter(clean).drop("violations"), every.filter(wrong), every.filter(~clean & ~wrong))
