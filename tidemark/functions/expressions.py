"""Policy expressions: a small safe grammar, parsed once and compiled to columns."""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BINARY: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / F.nullif(b, F.lit(0.0)), ast.Mod: lambda a, b: a % F.nullif(b, F.lit(0.0)),
}
_COMPARE: dict[type, Callable[[Column, Column], Column]] = {
    ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b,
}


class NotAllowed(ValueError):
    """The expression has a part outside the grammar, or a name that no column has."""


def _column(node: ast.expr, names: set[str]) -> Column:
    if isinstance(node, ast.Constant) and isinstance(node.value, (bool, int, float, str)):
        return F.lit(node.value)
    if isinstance(node, ast.Name):
        if node.id not in names:
            raise NotAllowed(node.id)
        return F.col(node.id)
    if isinstance(node, (ast.Attribute, ast.Subscript)):  # features.x, ctx["x"]
        name = node.attr if isinstance(node, ast.Attribute) else getattr(node.slice, "value", None)
        if not isinstance(node.value, ast.Name) or name not in names:
            raise NotAllowed(ast.unparse(node))
        return F.col(name)
    if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
        return _BINARY[type(node.op)](_column(node.left, names), _column(node.right, names))
    if isinstance(node, ast.UnaryOp):
        x = _column(node.operand, names)
        return ~x if isinstance(node.op, ast.Not) else -x if isinstance(node.op, ast.USub) else x
    if isinstance(node, ast.BoolOp):
        parts = [_column(v, names) for v in node.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(node.op, ast.And) else out | p
        return out
    if isinstance(node, ast.Compare) and all(type(o) in _COMPARE for o in node.ops):
        sides = [_column(v, names) for v in (node.left, *node.comparators)]
        out = None
        for op, a, b in zip(node.ops, sides, sides[1:]):
            c = _COMPARE[type(op)](a, b)
            out = c if out is None else out & c
        return out
    if isinstance(node, ast.IfExp):
        return F.when(_column(node.test, names), _column(node.body, names)).otherwise(_column(node.orelse, names))
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
        args = [_column(a, names) for a in node.args]
        if node.func.id == "abs" and len(args) == 1:
            return F.abs(args[0])
        if node.func.id in ("min", "max") and len(args) > 1:
            return (F.least if node.func.id == "min" else F.greatest)(*args)
    raise NotAllowed(ast.unparse(node))


def predicate(text: str, columns: list[str]) -> Column:
    """A condition; whatever is outside the grammar or null is false."""
    try:
        return F.coalesce(_column(ast.parse(text.strip(), mode="eval").body, set(columns)), F.lit(False))
    except (NotAllowed, SyntaxError):
        return F.lit(False)


def assignment(text: str, columns: list[str]) -> Column:
    """The right side of `name = ...`; whatever is outside the grammar or null is 0."""
    try:
        node = ast.parse(text.strip()).body[0]
        return F.coalesce(_column(node.value, set(columns)).cast("double"), F.lit(0.0)) if isinstance(node, (ast.Assign, ast.Expr)) else F.lit(0.0)
    except (NotAllowed, SyntaxError, IndexError):
        return F.lit(0.0)
