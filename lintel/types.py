"""The closed set of value types, their YAML forms and their Spark forms.

Whether a value may be null is said by what holds it (a field, an array, a map), never by its type.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

import yaml
from pyspark.sql import types as T


class TypeFormError(ValueError):
    """A type that cannot be read, or a name that is not declared."""


@dataclass(frozen=True)
class Field:
    name: str
    type: ValueType
    nullable: bool = False
    human_name: str = field(default="", compare=False)


@dataclass(frozen=True)
class ValueType:
    """kind with its parameters; the unused ones keep their defaults."""

    kind: str
    element: ValueType | None = None
    key: ValueType | None = None
    nullable: bool = False  # of elements or map values
    fields: tuple[Field, ...] = ()
    labels: tuple[str, ...] = ()
    precision: int | str = 0
    scale: int = 0
    zone: str = "none"
    target: str = ""
    pinnable: bool = False

    def __str__(self) -> str:
        match self.kind:
            case "array":
                return f"list({self.element})"
            case "map":
                return f"map({self.key}, {self.element})"
            case "struct":
                return "struct(" + ", ".join(f"{f.name} {f.type}" for f in self.fields) + ")"
            case "decimal":
                return f"decimal({self.precision},{self.scale})"
        return self.kind

    def same(self, other: ValueType) -> bool:
        """Equality in which a struct's field names do not count."""
        if self.kind != other.kind or len(self.fields) != len(other.fields):
            return False
        inner = [(self.element, other.element), (self.key, other.key), *((a.type, b.type) for a, b in zip(self.fields, other.fields, strict=True))]
        return all(a is b is None or (a is not None and b is not None and a.same(b)) for a, b in inner)


BOOL, STRING, BYTES, DATE, TIMESTAMP, DURATION, NULL, ANY, BOTTOM, TYPE = (
    ValueType("bool"),
    ValueType("string"),
    ValueType("blob"),
    ValueType("date"),
    ValueType("timestamp", precision="micros"),
    ValueType("duration"),
    ValueType("null"),
    ValueType("any"),
    ValueType("bottom"),
    ValueType("type"),
)
I8, I16, I32, I64 = (ValueType(f"i{n}") for n in (8, 16, 32, 64))
U8, U16, U32, U64 = (ValueType(f"u{n}") for n in (8, 16, 32, 64))
F32, F64 = ValueType("f32"), ValueType("f64")
SIGNED, UNSIGNED, FLOATS = ("i8", "i16", "i32", "i64"), ("u8", "u16", "u32", "u64"), ("f32", "f64")
INTEGERS = SIGNED + UNSIGNED
NUMERIC = (*INTEGERS, *FLOATS, "decimal")
#: Kinds that a map may be keyed by.
MAP_KEYS = (*INTEGERS, "bool", "string", "date", "timestamp", "uuid", "ipv4", "ipv6", "enum", "fixedchar")


def array(element: ValueType, nullable: bool = False) -> ValueType:
    return ValueType("array", element=element, nullable=nullable)


def mapping(key: ValueType, value: ValueType, nullable: bool = False) -> ValueType:
    if key.kind not in MAP_KEYS:
        raise TypeFormError(f"a map cannot be keyed by {key}")
    return ValueType("map", key=key, element=value, nullable=nullable)


def struct(*fields: Field) -> ValueType:
    return ValueType("struct", fields=tuple(fields))


# --- YAML -------------------------------------------------------------------------------------

WORDS = {
    "bool": BOOL, "boolean": BOOL, "i8": I8, "i16": I16, "i32": I32, "i64": I64, "int": I64, "u8": U8, "u16": U16, "u32": U32, "u64": U64, "uint": U64,
    "f32": F32, "f64": F64, "double": F64, "float": F64, "string": STRING, "blob": BYTES, "bytes": BYTES, "clob": ValueType("clob"), "date": DATE, "uuid": ValueType("uuid"),
    "ipv4": ValueType("ipv4"), "ipv6": ValueType("ipv6"), "null": NULL, "duration": DURATION, "any": ANY, "variant": ANY,
    "timestamp": ValueType("timestamp", precision="millis"), "decimal": ValueType("decimal", precision=38),
}
PRECISIONS = {"seconds": "seconds", "s": "seconds", "millis": "millis", "ms": "millis", "micros": "micros", "us": "micros", "nanos": "nanos", "ns": "nanos"}
#: Keys of each constructor's mapping: those it needs, and those it may have.
FORMS = {
    "decimal": ({"precision", "scale"}, set()),
    "timestamp": ({"precision", "timezone"}, set()),
    "array": ({"element"}, {"nullable"}),
    "map": ({"key", "value"}, {"nullable"}),
    "entity_ref": ({"target_type_id", "key"}, {"revision_pinnable"}),
    "fixedchar": ({"length"}, set()),
    "string": ({"max_length"}, set()),
}


class TypeBook:
    """Named types, which may refer to each other in any order but not in a circle."""

    def __init__(self, nodes: dict[str, Any] | None = None):
        self.nodes = dict(nodes or {})
        self.done: dict[str, ValueType] = {}
        self.open: list[str] = []
        for name in self.nodes:
            self.named(name)

    @classmethod
    def load(cls, text: str) -> TypeBook:
        root = yaml.safe_load(text)
        if not isinstance(root, dict) or not isinstance(root.get("types"), dict):
            raise TypeFormError("a type book is a mapping with `types`")
        return cls(root["types"])

    def named(self, name: str) -> ValueType:
        if name in self.open:
            raise TypeFormError("cyclic type: " + " -> ".join([*self.open, name]))
        if name not in self.done:
            if name not in self.nodes:
                raise TypeFormError(f"unknown type or reference `{name}`")
            self.open.append(name)
            self.done[name] = self.read(self.nodes[name])
            self.open.pop()
        return self.done[name]

    def parse(self, text: str) -> ValueType:
        return self.read(yaml.safe_load(text))

    def read(self, node: Any) -> ValueType:
        if node is None:
            return NULL
        if isinstance(node, str):
            return WORDS[node] if node in WORDS else self.named(node)
        if not isinstance(node, dict) or len(node) != 1:
            raise TypeFormError(f"a type is a word or a mapping with one key: {node!r}")
        ((kind, body),) = node.items()
        if kind == "ref":
            return self.named(body)
        if kind == "struct":
            if not isinstance(body, list):
                raise TypeFormError("`struct` takes a list of fields")
            return struct(*(self.read_field(x) for x in body))
        if kind == "enum":
            if not isinstance(body, list) or not all(isinstance(x, str) for x in body):
                raise TypeFormError("`enum` takes a list of strings")
            return ValueType("enum", labels=tuple(body))
        if kind not in FORMS:
            raise TypeFormError(f"unknown type constructor `{kind}`")
        needed, allowed = FORMS[kind]
        if not isinstance(body, dict) or not needed <= body.keys() <= needed | allowed:
            raise TypeFormError(f"`{kind}` takes {', '.join(sorted(needed))}: {body!r}")
        match kind:
            case "decimal":
                if not 0 < body["precision"] <= 38 or not 0 <= body["scale"] <= body["precision"]:
                    raise TypeFormError(f"no such decimal: {body!r}")
                return ValueType("decimal", precision=body["precision"], scale=body["scale"])
            case "timestamp":
                if body["precision"] not in PRECISIONS or body["timezone"] not in ("none", "utc_offset"):
                    raise TypeFormError(f"no such timestamp: {body!r}")
                return ValueType("timestamp", precision=PRECISIONS[body["precision"]], zone=body["timezone"])
            case "array":
                return array(self.read(body["element"]), bool(body.get("nullable", False)))
            case "map":
                return mapping(self.read(body["key"]), self.read(body["value"]), bool(body.get("nullable", False)))
            case "entity_ref":
                return ValueType("entity_ref", key=self.read(body["key"]), target=body["target_type_id"], pinnable=bool(body.get("revision_pinnable", False)))
            case "fixedchar":
                return ValueType("fixedchar", precision=body["length"])
        return ValueType("string", precision=body["max_length"])

    def read_field(self, node: Any) -> Field:
        if not isinstance(node, dict) or not {"name", "type"} <= node.keys():
            raise TypeFormError(f"a field has a name and a type: {node!r}")
        try:
            return Field(node["name"], self.read(node["type"]), bool(node.get("nullable", False)), node.get("human_name") or node["name"])
        except TypeFormError as error:
            raise TypeFormError(f"field `{node['name']}`: {error}") from error


def to_node(t: ValueType) -> Any:
    """The YAML form, inline: what TypeBook.read turns back into the type."""
    optional = {"nullable": True} if t.nullable else {}
    match t.kind:
        case "array":
            return {"array": {"element": to_node(t.element)} | optional}
        case "map":
            return {"map": {"key": to_node(t.key), "value": to_node(t.element)} | optional}
        case "struct":
            return {"struct": [{"name": f.name, "type": to_node(f.type)} | ({"nullable": True} if f.nullable else {}) | ({"human_name": f.human_name} if f.human_name not in ("", f.name) else {}) for f in t.fields]}
        case "enum":
            return {"enum": list(t.labels)}
        case "decimal":
            return {"decimal": {"precision": t.precision, "scale": t.scale}}
        case "timestamp":
            return {"timestamp": {"precision": t.precision, "timezone": t.zone}}
        case "entity_ref":
            return {"entity_ref": {"target_type_id": t.target, "key": to_node(t.key)} | ({"revision_pinnable": True} if t.pinnable else {})}
        case "fixedchar":
            return {"fixedchar": {"length": t.precision}}
        case "string" if t.precision:
            return {"string": {"max_length": t.precision}}
        case "null":
            return None
    return t.kind


def to_yaml(t: ValueType) -> str:
    return yaml.safe_dump(to_node(t), sort_keys=False)


# --- Spark ------------------------------------------------------------------------------------

#: Unsigned kinds are held by the next wider type; validation holds them to their range.
SCALARS = {
    "bool": T.BooleanType(), "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(), "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0),
    "f32": T.FloatType(), "f64": T.DoubleType(), "string": T.StringType(), "blob": T.BinaryType(), "clob": T.StringType(), "date": T.DateType(), "duration": T.DayTimeIntervalType(), "uuid": T.StringType(),
    "enum": T.StringType(), "ipv4": T.StringType(), "ipv6": T.StringType(), "null": T.NullType(), "any": T.VariantType(), "type": T.StringType(), "bottom": T.NullType(),
}
BY_SPARK = {"boolean": BOOL, "tinyint": I8, "smallint": I16, "int": I32, "bigint": I64, "float": F32, "double": F64, "string": STRING, "binary": BYTES, "date": DATE, "void": NULL, "variant": ANY}


def to_spark(t: ValueType) -> T.DataType:
    match t.kind:
        case "array":
            return T.ArrayType(to_spark(t.element), t.nullable)
        case "map":
            return T.MapType(to_spark(t.key), to_spark(t.element), t.nullable)
        case "struct":
            return T.StructType([T.StructField(f.name, to_spark(f.type), f.nullable, {"human_name": f.human_name or f.name}) for f in t.fields])
        case "decimal":
            return T.DecimalType(t.precision, t.scale)
        case "timestamp":
            if t.precision == "nanos":
                return T.LongType()  # Spark's timestamps are microseconds; nanoseconds stay a count
            if t.zone == "utc_offset":
                return T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("offset_min", T.ShortType())])
            return T.TimestampNTZType()
        case "entity_ref":
            key = to_spark(t.key)
            return T.StructType([T.StructField("key", key), T.StructField("revision", T.LongType())]) if t.pinnable else key
        case "fixedchar":
            return T.CharType(t.precision)
        case "string" if t.precision:
            return T.VarcharType(t.precision)
    return SCALARS[t.kind]


def from_spark(t: T.DataType) -> ValueType:
    match t:
        case T.ArrayType():
            return array(from_spark(t.elementType), t.containsNull)
        case T.MapType():
            return ValueType("map", key=from_spark(t.keyType), element=from_spark(t.valueType), nullable=t.valueContainsNull)
        case T.StructType():
            return struct(*(Field(f.name, from_spark(f.dataType), f.nullable, f.metadata.get("human_name", f.name)) for f in t.fields))
        case T.DecimalType():
            return ValueType("decimal", precision=t.precision, scale=t.scale)
        case T.TimestampType() | T.TimestampNTZType():
            return TIMESTAMP
        case T.DayTimeIntervalType():
            return DURATION
        case T.CharType() | T.VarcharType():
            return replace(STRING, precision=t.length)
    name = t.simpleString()
    if name not in BY_SPARK:
        raise TypeFormError(f"no value type for {name}")
    return BY_SPARK[name]
