"""Events as JSON text and as protobuf declarations of the same schema."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.types import ValueType, to_spark

# The wire form of each kind of field; all others are bytes.
WIRE = {"bool": "bool", "i8": "sint32", "i16": "sint32", "i32": "sint32", "i64": "sint64", "u8": "uint32", "u16": "uint32", "u32": "uint32", "u64": "uint64", "f32": "float", "f64": "double", "string": "string", "clob": "string", "date": "sint32", "timestamp": "sint64", "enum": "uint32"}
#: What a missing field reads as where nulls are not wanted.
DEFAULTS = {"bool": False, "string": "", "clob": "", **dict.fromkeys(("i8", "i16", "i32", "i64", "u8", "u16", "u32", "u64"), 0), "f32": 0.0, "f64": 0.0}


def proto(schema: ValueType, message: str, package: str, keep: Iterable[str] | None = None) -> str:
    """A proto3 declaration; with keep, only of those fields, under the numbers they have in the whole."""
    kept = None if keep is None else set(keep)
    lines = [f"  {WIRE.get(f.type.kind, 'bytes')} {f.name} = {n};" for n, f in enumerate(schema.fields, 1) if kept is None or f.name in kept]
    return "\n".join(['syntax = "proto3";', "", f"package {package};", "", f"message {message} {{", *lines, "}", ""])


def event(text: Column, schema: ValueType, defaults: bool = False) -> Column:
    """JSON text as a struct of the schema, null for what is no JSON object.

    Missing and mistyped fields are null, or with defaults the default of their type.
    """
    parsed = F.from_json(text, to_spark(schema), {"mode": "PERMISSIVE"})
    whole = F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT")
    fields = [(F.coalesce(parsed.getField(f.name), F.lit(DEFAULTS[f.type.kind]).cast(to_spark(f.type))) if defaults and f.type.kind in DEFAULTS else parsed.getField(f.name)).alias(f.name) for f in schema.fields]
    return F.when(whole, F.struct(*fields))


def read_events(df: DataFrame, column: str, schema: ValueType, defaults: bool = False, keep: Iterable[str] | None = None) -> DataFrame:
    """df with the text replaced by the event's fields, or by those to keep; malformed texts give nulls and `malformed`."""
    names = [f.name for f in schema.fields if keep is None or f.name in set(keep)]
    own = df.withColumn("_event", event(F.col(column), schema, defaults))
    rest = [c for c in df.columns if c != column and c not in names]
    return own.select(*rest, *(F.col("_event").getField(n).alias(n) for n in names), (F.col("_event").isNull() & F.col(column).isNotNull()).alias("malformed"))
