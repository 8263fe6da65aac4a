"""The header predicate language, compiled to Spark columns.

    query  := group { " OR " group }
    group  := [ "NOT " ] clause { " AND " clause }
    clause := field OP value          OP: == != >= <= > <

The words split wherever they stand, quoted or not, and NOT counts at the very
start of a group only. A field may have any number of values: != holds if none
of them equals, any other operator if some value does. Values are compared as
numbers if both sides are numbers, else only == and != mean anything. On the
field Subject every operator means "contains, in any case".

Compiled predicates are never null, so they can be negated and combined.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = tuple("== != >= <= > <".split())
TOLERANCE = 1e-9
_NUMBER = r"(?i)^[+-]?(inf(inity)?|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"
_BLANK = " \t\n\r\x0b\x0c\x85\xa0"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class QueryError(ValueError):
    """A query that doesn't follow the grammar."""


@dataclass(frozen=True)
class Clause:
    field: str
    op: str
    value: str


@dataclass(frozen=True)
class Group:
    negated: bool
    clauses: tuple[Clause, ...]


def number(s: str) -> float | None:
    """s as a number by the language's own rules, None if it isn't one."""
    s = s.strip()
    return float(s) if re.match(_NUMBER, s) and s.isascii() else None


def _clause(text: str) -> Clause:
    for i in range(len(text)):
        op = next((o for o in OPERATORS if text.startswith(o, i)), None)
        if op is None:
            continue
        field, value = text[:i].strip(), text[i + len(op) :].strip().strip("\"'")
        if not field:
            raise QueryError(f"no field in: {text}")
        if not value:
            raise QueryError(f"no value in: {text}")
        return Clause(field.lower(), op, value)
    raise QueryError(f"no operator in: {text}")


def _conjunction(text: str) -> tuple[Clause, ...]:
    got = tuple(_clause(p.strip()) for p in text.split(" AND ") if p.strip())
    if not got:
        raise QueryError("nothing to compare")
    return got


def parse(query: str) -> list[Group]:
    """The groups that the query joins by OR; any malformed one is an error."""
    if " OR " not in query and "NOT " not in query:
        return [Group(False, _conjunction(query))]
    out = []
    for part in query.split(" OR "):
        negated = part.startswith("NOT ")
        out.append(Group(negated, _conjunction((part[4:] if negated else part).strip())))
    return out


# --- evaluation without Spark, for small header lists


def _same(v: str, value: str, op: str) -> bool:
    x, y = number(v), number(value)
    if x is not None and y is not None:
        return {"==": abs(x - y) < TOLERANCE, ">=": x >= y, "<=": x <= y, ">": x > y, "<": x < y}[op]
    return op == "==" and v == value


def matches(headers: list[tuple[str, str]], query: str) -> bool:
    """Whether a header list satisfies the query."""

    def holds(c: Clause) -> bool:
        values = [v for k, v in headers if k.translate(str.maketrans(_UPPER, _LOWER)) == c.field]
        if c.field == "subject":
            return any(c.value.lower() in v.lower() for v in values)
        if c.op == "!=":
            return not any(_same(v, c.value, "==") for v in values)
        return any(_same(v, c.value, c.op) for v in values)

    return any(all(map(holds, g.clauses)) != g.negated for g in parse(query))


# --- compilation


def _number(v: Column) -> Column:
    s = F.btrim(v, F.lit(_BLANK))
    return F.when(s.rlike(_NUMBER), s.try_cast("double"))


def _value_test(c: Clause, op: str) -> Callable[[Column], Column]:
    """The test of one string value against the clause's."""
    y = number(c.value)
    same = lambda v: (v == F.lit(c.value)) if op == "==" else F.lit(False)
    if y is None:
        return same

    def test(v: Column) -> Column:
        x = _number(v)
        lit = F.lit(y)
        if op == "==":
            hit = F.abs(x - lit) < F.lit(TOLERANCE)
        else:
            hit = {">=": x >= lit, "<=": x <= lit, ">": x > lit, "<": x < lit}[op] & ~F.isnan(x) & F.lit(y == y)
        return F.coalesce(F.when(x.isNotNull(), hit).otherwise(same(v)), F.lit(False))

    return test


@dataclass(frozen=True)
class Field:
    """Where a field's values are: an array of strings, one string, one whole number or one of floating point; null for none."""

    source: Column | str
    kind: str  # strings, string, number, float

    @property
    def column(self) -> Column:
        return F.col(self.source) if isinstance(self.source, str) else self.source

    def some(self, c: Clause, op: str) -> Column:
        if self.kind in ("number", "float"):
            y = number(c.value)
            if y is None or y != y:
                return F.lit(False)
            whole = self.kind == "number" and abs(y) < 2**53
            return self.column.isNotNull() & (self._whole(y, op) if whole else self._float(y, op))  # never null, and pushed down to the scan
        if self.kind == "string":
            if number(c.value) is None and op == "==":
                return self.column.isNotNull() & (self.column == F.lit(c.value))
            return F.coalesce(_value_test(c, op)(self.column), F.lit(False))
        if number(c.value) is None and op == "==":
            return F.coalesce(F.array_contains(self.column, F.lit(c.value)), F.lit(False))
        return F.coalesce(F.exists(self.column, _value_test(c, op)), F.lit(False))

    def _whole(self, y: float, op: str) -> Column:
        """Comparisons of whole numbers, by whole literals."""
        x = self.column
        if op == "==":
            return x == F.lit(round(y)) if abs(round(y) - y) < TOLERANCE else F.lit(False)
        return {">=": x >= F.lit(math.ceil(y)), "<=": x <= F.lit(math.floor(y)), ">": x > F.lit(math.floor(y)), "<": x < F.lit(math.ceil(y))}[op]

    def _float(self, y: float, op: str) -> Column:
        """Comparisons as IEEE has them: NaN compares with nothing, and an infinite number equals none within the tolerance."""
        x, lit = self.column.cast("double"), F.lit(y)
        if op == "==":
            if math.isinf(y):
                return F.lit(False)
            return (x >= F.lit(y - 2 * TOLERANCE)) & (x <= F.lit(y + 2 * TOLERANCE)) & (F.abs(x - lit) < F.lit(TOLERANCE))
        if op in (">=", ">"):
            return (x >= lit if op == ">=" else x > lit) & ~F.isnan(x)
        return x <= lit if op == "<=" else x < lit

    def contains(self, c: Clause) -> Column:
        low = c.value.lower()
        one = lambda v: F.coalesce(F.contains(F.lower(v), F.lit(low)), F.lit(False))
        if self.kind == "strings":
            return F.coalesce(F.exists(self.column, one), F.lit(False))
        return one(self.column.cast("string"))


def _in_headers(headers: Column, name: str) -> Field:
    fit = F.filter(headers, lambda h: F.translate(h["k"], _UPPER, _LOWER) == F.lit(name.translate(str.maketrans(_UPPER, _LOWER))))
    return Field(F.transform(fit, lambda h: h["v"]), "strings")


def compile_query(query: str, headers: Column | None = None, fields: dict[str, Field] | None = None) -> Column:
    """A non-null boolean column for the query.

    headers is an ARRAY<STRUCT<k, v>>. fields holds columns of their own for
    some fields, by lower-case name; with those, comparisons can reach the scan.
    A field that is nowhere has no values.
    """
    fields = fields or {}

    def holds(c: Clause) -> Column:
        f = fields.get(c.field) or (_in_headers(headers, c.field) if headers is not None else None)
        if f is None:
            return F.lit(c.op == "!=" and c.field != "subject")
        if c.field == "subject":
            return f.contains(c)
        return ~f.some(c, "==") if c.op == "!=" else f.some(c, c.op)

    out = None
    for g in parse(query):
        group = None
        for c in g.clauses:
            group = holds(c) if group is None else group & holds(c)
        group = ~group if g.negated else group
        out = group if out is None else out | group
    return out


def compile_store_query(query: str, headers: Column | None = None, fields: dict[str, Field] | None = None) -> Column:
    """As compile_query, by the store's rule: the whole string must also do as one AND group, else it is an error."""
    _conjunction(query)
    return compile_query(query, headers, fields)
