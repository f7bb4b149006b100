"""Metadata filters: text to syntax tree to Spark column.

    filter  := and (OR and)*
    and     := unary (AND unary)*
    unary   := NOT unary | '(' filter ')' | test
    test    := field (== | != | < | <= | > | >=) literal | field IN '(' literal, ... ')'
             | field CONTAINS literal | field EXISTS

Logic is two-valued: a test on a missing field is false, ``!=`` too, and NOT makes
it true.  Values of different types are equal if they read alike (3 and "3"), and
have no order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.errors import FilterSyntaxError

Literal = bool | float | str
KEYWORDS = {"AND", "OR", "NOT", "IN", "CONTAINS", "EXISTS", "TRUE", "FALSE"}


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: Literal


@dataclass(frozen=True)
class In:
    field: str
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class Contains:
    field: str
    value: Literal


@dataclass(frozen=True)
class Exists:
    field: str


@dataclass(frozen=True)
class Not:
    item: Expr


@dataclass(frozen=True)
class And:
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class Or:
    items: tuple[Expr, ...]


Expr = Compare | In | Contains | Exists | Not | And | Or

_TOKEN = re.compile(
    r"""\s*(?:
        (?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
      | (?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
      | (?P<word>[^\W\d][\w.\-]*)
      | (?P<op>==|!=|<=|>=|<|>)
      | (?P<mark>[(),])
    )""",
    re.VERBOSE | re.DOTALL,
)


def tokenize(text: str) -> list[tuple[str, object]]:
    """``(kind, value)`` of each token; kinds: text, number, word, keyword, op, mark."""
    found: list[tuple[str, object]] = []
    at = 0
    end = len(text.rstrip())
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            rest = text[at:end].lstrip()
            raise FilterSyntaxError(f"unexpected {'unfinished text' if rest[0] in chr(34) + chr(39) else rest[0]!r} at {len(text[:end]) - len(rest)}")
        kind, raw = m.lastgroup, m[m.lastgroup]
        if kind == "text":
            found.append((kind, re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), raw[1:-1], flags=re.DOTALL)))
        elif kind == "number":
            found.append((kind, float(raw)))
        elif kind == "word" and raw.upper() in KEYWORDS:
            found.append(("keyword", raw.upper()))
        else:
            found.append((kind, raw))
        at = m.end()
    return found


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokenize(text), 0

    def peek(self) -> tuple[str, object]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "end of filter")

    def take(self, kind: str, value: object = None) -> object | None:
        k, v = self.peek()
        if k == kind and (value is None or v == value):
            self.at += 1
            return v
        return None

    def need(self, kind: str, value: object = None) -> object:
        got = self.take(kind, value)
        if got is None:
            raise FilterSyntaxError(f"expected {value or kind}, found {self.peek()[1]!r}")
        return got

    def any_of(self) -> Expr:
        items = [self.all_of()]
        while self.take("keyword", "OR"):
            items.append(self.all_of())
        return items[0] if len(items) == 1 else Or(tuple(items))

    def all_of(self) -> Expr:
        items = [self.unary()]
        while self.take("keyword", "AND"):
            items.append(self.unary())
        return items[0] if len(items) == 1 else And(tuple(items))

    def unary(self) -> Expr:
        if self.take("keyword", "NOT"):
            return Not(self.unary())
        if self.take("mark", "("):
            inner = self.any_of()
            self.need("mark", ")")
            return inner
        field = self.need("word")
        if op := self.take("op"):
            return Compare(field, op, self.literal())
        if self.take("keyword", "EXISTS"):
            return Exists(field)
        if self.take("keyword", "CONTAINS"):
            return Contains(field, self.literal())
        self.need("keyword", "IN")
        self.need("mark", "(")
        values = [self.literal()]
        while self.take("mark", ","):
            values.append(self.literal())
        self.need("mark", ")")
        return In(field, tuple(values))

    def literal(self) -> Literal:
        for kind in ("text", "number", "word"):
            if (value := self.take(kind)) is not None:
                return value
        for word, value in (("TRUE", True), ("FALSE", False)):
            if self.take("keyword", word):
                return value
        raise FilterSyntaxError(f"expected a value, found {self.peek()[1]!r}")


def parse(text: str) -> Expr:
    parser = _Parser(text)
    tree = parser.any_of()
    if parser.peek()[0] != "end":
        raise FilterSyntaxError(f"unexpected {parser.peek()[1]!r} after the filter")
    return tree


def fields(expr: Expr) -> set[str]:
    """Fields that a filter reads."""
    if isinstance(expr, Not):
        return fields(expr.item)
    if isinstance(expr, And | Or):
        return set().union(*map(fields, expr.items))
    return {expr.field}


def render(value: object) -> str:
    """How a value reads: whole numbers below 1e15 without a fraction, lists joined by commas."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int | float):
        x = float(value)
        return str(int(x)) if x == x and abs(x) < 1e15 and x == int(x) else repr(x)
    if isinstance(value, list | tuple):
        return ",".join(map(render, value))
    return str(value)


# Evaluation in Python: the meaning that columns must have, and the oracle of their tests.


def _kind(value: object) -> str:
    return "bool" if isinstance(value, bool) else "num" if isinstance(value, int | float) else "list" if isinstance(value, list | tuple) else "str"


def _compare(value: object, op: str, literal: object) -> bool:
    a, b = _kind(value), _kind(literal)
    if op in ("==", "!="):
        same = value == literal if a == b != "list" else render(value) == render(literal)
        return same == (op == "==")
    if a != b or a not in ("num", "str"):
        return False
    return {"<": value < literal, "<=": value <= literal, ">": value > literal, ">=": value >= literal}[op]


def matches(expr: Expr, metadata: Mapping[str, object] | None) -> bool:
    """Whether a row with this metadata (none: no fields) passes."""
    if isinstance(expr, Not):
        return not matches(expr.item, metadata)
    if isinstance(expr, And):
        return all(matches(x, metadata) for x in expr.items)
    if isinstance(expr, Or):
        return any(matches(x, metadata) for x in expr.items)
    if not metadata or expr.field not in metadata:
        return False
    value = metadata[expr.field]
    if isinstance(expr, Exists):
        return True
    if isinstance(expr, Compare):
        return _compare(value, expr.op, expr.value)
    if isinstance(expr, In):
        return any(_compare(value, "==", x) for x in expr.values)
    if _kind(value) == "list":
        return any(_compare(x, "==", expr.value) for x in value)
    return _kind(value) == "str" and render(expr.value) in value


# Compilation.  A leaf is null where its field is missing; that is as good as
# false, save beneath NOT, and leaving it so lets the leaf reach the Parquet scan.


class TypedColumns:
    """Fields that are columns of a table, by name."""

    def __init__(self, schema: T.StructType):
        self.types = {f.name: f.dataType for f in schema}

    def leaf(self, expr: Compare | In | Contains | Exists) -> Column:
        kind = self.types.get(expr.field)
        if kind is None:
            return F.lit(False)
        column = F.col(f"`{expr.field}`")
        if isinstance(expr, Exists):
            return column.isNotNull()
        if isinstance(expr, In):
            ours = {T.StringType: str, T.BooleanType: bool}.get(type(kind), float)
            if not isinstance(kind, T.ArrayType) and all(type(v) is ours for v in expr.values):
                return column.isin(*expr.values)
            tests = [self._compare(column, kind, "==", v) for v in expr.values]
            out = tests[0]
            for t in tests[1:]:
                out = out | t
            return out
        if isinstance(expr, Contains):
            if isinstance(kind, T.ArrayType):
                return F.exists(column, lambda x: F.coalesce(self._compare(x, kind.elementType, "==", expr.value), F.lit(False)))
            if isinstance(kind, T.StringType):
                return F.contains(column, F.lit(render(expr.value)))
            return F.when(column.isNotNull(), F.lit(False))
        return self._compare(column, kind, expr.op, expr.value)

    @staticmethod
    def _render(column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.ArrayType):
            return F.array_join(F.transform(column, lambda x: TypedColumns._render(x, kind.elementType)), ",")
        if isinstance(kind, T.FractionalType):
            whole = (F.abs(column) < 1e15) & (column == F.floor(column))
            return F.when(whole, column.cast("long").cast("string")).otherwise(column.cast("string"))
        return column.cast("string")

    def _compare(self, column: Column, kind: T.DataType, op: str, value: Literal) -> Column:
        ours = "bool" if isinstance(kind, T.BooleanType) else "num" if isinstance(kind, T.NumericType) else "str" if isinstance(kind, T.StringType) else "other"
        if ours == _kind(value) and (ours != "bool" or op in ("==", "!=")):
            literal = F.lit(int(value)) if ours == "num" and isinstance(kind, T.IntegralType) and value == int(value) and abs(value) < 1 << 53 else F.lit(value)
        elif op in ("==", "!="):
            column, literal = self._render(column, kind), F.lit(render(value))
        else:
            return F.when(column.isNotNull(), F.lit(False))
        return {"==": column == literal, "!=": column != literal, "<": column < literal, "<=": column <= literal, ">": column > literal, ">=": column >= literal}[op]


#: A metadata value: its kind (bool, num, str, list), the value in the field of its kind, and how it reads (``s``).
VALUE = "struct<kind: string, b: boolean, n: double, s: string, items: array<struct<kind: string, b: boolean, n: double, s: string>>>"
METADATA = f"map<string, {VALUE}>"


def tagged(value: object) -> dict:
    """A value as a row of type :data:`VALUE`; null and nested objects aren't values."""
    if value is None or isinstance(value, dict):
        raise FilterSyntaxError("metadata values are booleans, numbers, texts and lists of them")
    kind = _kind(value)
    out = {"kind": kind, "b": value if kind == "bool" else None, "n": float(value) if kind == "num" else None, "s": render(value)}
    return out | {"items": [{k: v for k, v in tagged(x).items() if k != "items"} for x in value] if kind == "list" else None}


def untagged(row: Mapping) -> object:
    if row["kind"] == "list":
        return [untagged({**dict(x.asDict() if hasattr(x, "asDict") else x), "items": []}) for x in row["items"]]
    return {"bool": row["b"], "num": row["n"], "str": row["s"]}[row["kind"]]


class TaggedMap:
    """Fields that are keys of a map column of type :data:`METADATA`."""

    def __init__(self, column: Column):
        self.column = column

    def leaf(self, expr: Compare | In | Contains | Exists) -> Column:
        value = F.try_element_at(self.column, F.lit(expr.field))
        if isinstance(expr, Exists):
            return value.isNotNull()
        if isinstance(expr, Compare):
            return self._compare(value, expr.op, expr.value)
        if isinstance(expr, In):
            tests = [self._compare(value, "==", v) for v in expr.values]
            out = tests[0]
            for t in tests[1:]:
                out = out | t
            return out
        inside = F.exists(value["items"], lambda x: F.coalesce(self._compare(x, "==", expr.value), F.lit(False)))
        return F.when(value["kind"] == "list", inside).when(value["kind"] == "str", F.contains(value["s"], F.lit(render(expr.value)))).when(value.isNotNull(), F.lit(False))

    @staticmethod
    def _compare(value: Column, op: str, literal: Literal) -> Column:
        kind = _kind(literal)
        if op in ("==", "!="):
            same = F.when((value["kind"] == "num"), value["n"] == literal).otherwise(value["s"] == render(literal)) if kind == "num" else value["s"] == render(literal)
            return same if op == "==" else ~same
        if kind == "bool":
            return F.when(value.isNotNull(), F.lit(False))
        field = value["n"] if kind == "num" else value["s"]
        ordered = {"<": field < literal, "<=": field <= literal, ">": field > literal, ">=": field >= literal}[op]
        return F.when(value["kind"] == kind, ordered).when(value.isNotNull(), F.lit(False))


def to_column(expr: Expr | str, source: TypedColumns | TaggedMap) -> Column:
    """The filter as a column for ``where``; null counts as false."""
    expr = parse(expr) if isinstance(expr, str) else expr

    def build(e: Expr, beneath_not: bool) -> Column:
        if isinstance(e, Not):
            return ~build(e.item, True)
        if isinstance(e, And | Or):
            parts = [build(x, beneath_not) for x in e.items]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(e, And) else out | p
            return out
        leaf = source.leaf(e)
        return F.coalesce(leaf, F.lit(False)) if beneath_not else leaf

    return build(expr, False)


def leaves(expr: Expr) -> Iterator[Expr]:
    if isinstance(expr, Not):
        yield from leaves(expr.item)
    elif isinstance(expr, And | Or):
        for x in expr.items:
            yield from leaves(x)
    else:
        yield expr
