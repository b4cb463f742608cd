"""Expressions: immutable trees that all passes share, whatever text or code they came from."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

from lintel.types import NULL, ValueType


@dataclass(frozen=True)
class Expr:
    def children(self) -> tuple[Expr, ...]:
        return ()

    def with_children(self, children: tuple[Expr, ...]) -> Expr:
        return self

    def walk(self) -> Iterator[Expr]:
        yield self
        for child in self.children():
            yield from child.walk()


@dataclass(frozen=True)
class Lit(Expr):
    value: Any
    type: ValueType = NULL


@dataclass(frozen=True)
class Name(Expr):
    """A field of the row."""

    name: str


@dataclass(frozen=True)
class At(Expr):
    """A field of the row by position."""

    index: int


@dataclass(frozen=True)
class Var(Expr):
    """An element that an enclosing quantifier binds; never a field."""

    name: str


@dataclass(frozen=True)
class Child(Expr):
    """A struct's field, by name or by position."""

    of: Expr
    field: str | int

    def children(self) -> tuple[Expr, ...]:
        return (self.of,)

    def with_children(self, children: tuple[Expr, ...]) -> Expr:
        return replace(self, of=children[0])


@dataclass(frozen=True)
class Call(Expr):
    """An operator of the catalog."""

    op: str
    args: tuple[Expr, ...]

    def children(self) -> tuple[Expr, ...]:
        return self.args

    def with_children(self, children: tuple[Expr, ...]) -> Expr:
        return replace(self, args=children)


@dataclass(frozen=True)
class Over(Expr):
    """A quantifier or comprehension: op over the elements of a list, or the keys of a map."""

    op: str
    of: Expr
    var: str
    body: Expr
    where: Expr | None = None

    def children(self) -> tuple[Expr, ...]:
        return (self.of, self.body, *([self.where] if self.where else []))

    def with_children(self, children: tuple[Expr, ...]) -> Expr:
        return replace(self, of=children[0], body=children[1], where=children[2] if self.where else None)


@dataclass(frozen=True)
class Case(Expr):
    """The first arm whose condition holds, or the default."""

    arms: tuple[tuple[Expr, Expr], ...]
    default: Expr

    def children(self) -> tuple[Expr, ...]:
        return (*(x for arm in self.arms for x in arm), self.default)

    def with_children(self, children: tuple[Expr, ...]) -> Expr:
        return Case(tuple(zip(children[0:-1:2], children[1:-1:2], strict=True)), children[-1])


@dataclass(frozen=True)
class Make(Expr):
    """A list, map (keys and values in turn) or struct (with names) of parts."""

    kind: str
    parts: tuple[Expr, ...]
    names: tuple[str, ...] = ()

    def children(self) -> tuple[Expr, ...]:
        return self.parts

    def with_children(self, children: tuple[Expr, ...]) -> Expr:
        return replace(self, parts=children)


@dataclass(frozen=True)
class Cast(Expr):
    """A conversion that the type check put in."""

    of: Expr
    to: ValueType

    def children(self) -> tuple[Expr, ...]:
        return (self.of,)

    def with_children(self, children: tuple[Expr, ...]) -> Expr:
        return replace(self, of=children[0])


@dataclass(frozen=True)
class Udf(Expr):
    """A call of an imported function by its visible name; ref is set once it is resolved."""

    name: str
    args: tuple[Expr, ...]
    ref: tuple[str, str, str] | None = None

    def children(self) -> tuple[Expr, ...]:
        return self.args

    def with_children(self, children: tuple[Expr, ...]) -> Expr:
        return replace(self, args=children)


@dataclass(frozen=True)
class Opaque(Expr):
    """Text that has no meaning in the catalog; free are the names that it reads."""

    source: str
    free: tuple[str, ...] = ()


def rewrite(expr: Expr, fn: Callable[[Expr], Expr]) -> Expr:
    """fn applied to every node, children first."""
    old = expr.children()
    new = tuple(rewrite(c, fn) for c in old)
    return fn(expr if new == old else expr.with_children(new))
