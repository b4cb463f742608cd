"""Functions from outside: modules of declarations, and implementations that keep one null rule.

A null, or a value of another type, for a parameter that is not optional makes the result null and
the function is not called; an optional parameter sees null as None. Implementations run on Arrow
batches of values. A function in the expression language itself is inlined as a column instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from itertools import repeat

import pyarrow as pa
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lintel.types import Field, TypeBook, ValueType, to_spark

Ref = tuple[str, str, str]


class UdfError(ValueError):
    pass


@dataclass(frozen=True)
class Function:
    """A declared function. language: opaque (never folded), cel (inlined) or wasm (named, but not run here)."""

    namespace: str
    version: str
    id: str
    name: str
    params: tuple[Field, ...]
    result: ValueType
    language: str = "opaque"
    body: Callable | str | None = None
    notes: str = field(default="", compare=False)

    @property
    def ref(self) -> Ref:
        return self.namespace, self.version, self.name

    def column(self, *args: Column) -> Column:
        if self.language == "cel":
            return self.inlined(args)
        if not callable(self.body):
            raise UdfError(f"{':'.join(self.ref)} is declared but has no implementation")
        body, optional, arity, kinds = self.body, [p.nullable for p in self.params], len(self.params), [PYTHON.get(p.type.kind) for p in self.params]
        returns = relaxed(to_spark(self.result))
        names, arrow = [f.name for f in self.result.fields], to_arrow_type(returns)

        def checked(values: list, kind) -> list:
            return values if kind is None else [v if isinstance(v, kind) else None for v in values]

        @F.arrow_udf(returns)
        def call(*columns: pa.Array) -> pa.Array:
            given = [checked(c.to_pylist(), kind) for c, kind in zip(columns, kinds, strict=False)]
            needed = [values for values, may in zip(given, optional, strict=True) if not may]
            rows = zip(*given, strict=True) if arity else repeat((), len(columns[0]))
            lacking = (any(v is None for v in r) for r in zip(*needed, strict=True)) if needed else repeat(False)
            out = [None if lacks else body(*values) for values, lacks in zip(rows, lacking, strict=False)]
            return pa.array([dict(zip(names, x, strict=True)) if names and isinstance(x, tuple) else x for x in out], arrow)

        # a function of nothing needs a column that tells how many rows there are
        return (call if self.language != "opaque" else call.asNondeterministic())(*(args or (F.lit(0),)))

    def inlined(self, args: tuple[Column, ...]) -> Column:
        from lintel.functions.cel import parse
        from lintel.functions.lower import Lowering
        from lintel.ir import Name, Var, rewrite
        from lintel.plans.typecheck import Checker, Schema

        names = {p.name for p in self.params}
        expr = rewrite(parse(self.body).expr, lambda n: Var(n.name) if isinstance(n, Name) and n.name in names else n)
        typed = Checker(Schema(())).check(expr, {p.name: (p.type, True) for p in self.params})
        typed = Checker(Schema(())).fit(typed, self.result, self.name)
        pair = Lowering().lower(typed, {p.name: a for p, a in zip(self.params, args, strict=True)})
        return pair.value if pair.error is None else F.when(~pair.error, pair.value)


def relaxed(t: T.DataType) -> T.DataType:
    """The type with every part nullable, which is how results come back from Arrow."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, relaxed(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(relaxed(t.elementType))
    return T.MapType(t.keyType, relaxed(t.valueType)) if isinstance(t, T.MapType) else t


#: What Arrow hands over for values of a kind.
PYTHON = {"string": str, "bool": bool, "blob": (bytes, bytearray), **{k: int for k in ("i8", "i16", "i32", "i64", "u8", "u16", "u32")}, "f32": (float, int), "f64": (float, int)}


class Registry:
    """Functions by namespace, version and name; what passes and lowering look up."""

    def __init__(self):
        self.functions: dict[Ref, Function] = {}

    def add(self, function: Function) -> Function:
        if function.ref in self.functions:
            raise UdfError(f"{':'.join(function.ref)} is there already; publish a new version")
        self.functions[function.ref] = function
        return function

    def load(self, text: str, bodies: dict[str, Callable] | None = None, book: TypeBook | None = None) -> list[Function]:
        """All functions of a module's YAML; bodies: implementations by id."""
        root = yaml.safe_load(text)
        for key in ("namespace", "version", "functions"):
            if not isinstance(root, dict) or key not in root:
                raise UdfError(f"a module states its {key}")
        book, out = book or TypeBook(), []
        for node in root["functions"]:
            language = node.get("language", "cel" if "body" in node else "opaque")
            params = tuple(Field(p["name"], book.read(p["type"]), bool(p.get("nullable", False)), p["name"]) for p in node.get("params", []))
            out.append(Function(root["namespace"], str(root["version"]), node["id"], node.get("cel", node["id"]), params, book.read(node["return_type"]), language, node.get("body") or (bodies or {}).get(node["id"]), node.get("notes", "")))
        return [self.add(f) for f in out]

    def implement(self, ref: Ref, body: Callable) -> None:
        self.functions[ref] = replace(self.functions[ref], body=body)

    @property
    def arities(self) -> dict[Ref, int]:
        return {ref: len(f.params) for ref, f in self.functions.items()}

    @property
    def languages(self) -> dict[Ref, str]:
        return {ref: f.language for ref, f in self.functions.items()}

