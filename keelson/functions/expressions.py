"""Syntax trees compiled to columns.

Values are 64-bit integers that wrap (the session has ANSI off) and strings compared by bytes; truth is 1 or 0. Kinds are
known when compiling, but a kind error only counts for a row that evaluates it, so it becomes a raise_error() in the tree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError, quoted
from ..plans.schema import Kind, TableSchema, kind_of
from ..plans.syntax import Binary, Listed, Literal, Name, Node, Unary

Typed = tuple[Column, Kind | None]
"""A column and its kind; None for one that always raises."""

_COMPARE = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def failing(message: str, *first: Column) -> Column:
    """Raises message, after what evaluating the columns in first raises: the message depends on them, so they can't be left out."""
    nothing = [F.substring(c.cast("string"), 1, 0) for c in first]
    return F.raise_error(F.concat(F.lit(message), *nothing)).cast("bigint")


def _whole(condition: Column) -> Column:
    return condition.cast("bigint")


def _truth(value: Typed) -> Column:
    column, kind = value
    return F.length(column) > 0 if kind is Kind.TEXT else column != 0


def compile_expression(schema: TableSchema, node: Node, strict: bool = False) -> Typed:
    """strict: a name that isn't a column is refused now and not where a row evaluates it. A list's items aren't compiled."""
    match node:
        case Name(name):
            found = schema.column(name)
            if found is None and strict:
                raise EngineError(f"no such column {quoted(name)}")
            if found is None:
                return failing(f"no such column {quoted(name)}"), None
            return F.col(f"`{name}`"), found.kind
        case Literal(value):
            return F.lit(value).cast(kind_of(value).spark), kind_of(value)
        case Unary(op, operand):
            value = compile_expression(schema, operand, strict)
            if value[1] is None:
                return value
            if op == "not":
                return _whole(~_truth(value)), Kind.INT
            if value[1] is Kind.TEXT:
                return failing("unary minus requires an integer", value[0]), None
            return -value[0], Kind.INT
        case Listed():
            return failing("cannot evaluate a list of values"), None
        case Binary(op, left, right):
            return _binary(op, compile_expression(schema, left, strict), compile_expression(schema, right, strict))
    raise EngineError(f"cannot evaluate {node!r}")


def _binary(op: str, left: Typed, right: Typed) -> Typed:
    if left[1] is None:
        return left
    if op in ("and", "or"):
        then = right[0] if right[1] is None else _whole(_truth(right))
        settled = ~_truth(left) if op == "and" else _truth(left)
        return F.when(settled, F.lit(int(op == "or")).cast("bigint")).otherwise(then), Kind.INT
    if right[1] is None:
        return F.coalesce(F.nullif(left[0], left[0]).cast("bigint"), right[0]), None  # left first, then what right raises
    if op in _COMPARE:
        if left[1] is not right[1]:
            return failing("cannot compare values of different types", left[0], right[0]), None
        return _whole(_COMPARE[op](left[0], right[0])), Kind.INT
    if Kind.TEXT in (left[1], right[1]):
        return failing("arithmetic requires integers", left[0], right[0]), None
    a, b = left[0], right[0]
    if op == "/":
        return F.when(b == 0, failing("division by zero")).otherwise(F.call_function("div", a, b)), Kind.INT
    return {"+": a + b, "-": a - b, "*": a * b}[op], Kind.INT
