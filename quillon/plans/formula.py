"""Formulas over columns of one row: parsed, bounded, and turned into a Column. Nothing is ever evaluated as code."""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.guards import ieee_divide

MOST_CHARACTERS, MOST_DEPTH = 2000, 40
BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: ieee_divide, ast.Mod: lambda a, b: a % b, ast.Pow: lambda a, b: F.pow(a, b)}
COMPARE = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}
FUNCTIONS = {
    "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "log1p": F.log1p, "floor": F.floor, "ceil": F.ceil, "round": F.rint,
    "sin": F.sin, "cos": F.cos, "minimum": F.least, "maximum": F.greatest, "clip": lambda x, lo, hi: F.least(F.greatest(x, lo), hi), "where": lambda c, a, b: F.when(c, a).otherwise(b),
}


def columns_in(text: str) -> list[str]:
    """Names of the columns that a formula reads."""
    return sorted({n.id for n in ast.walk(parsed(text)) if isinstance(n, ast.Name)} - FUNCTIONS.keys())


def parsed(text: str) -> ast.expr:
    if len(text) > MOST_CHARACTERS:
        raise ValueError("the formula is too long")
    return ast.parse(text, mode="eval").body


def compiled(text: str, columns: list[str] | None = None) -> Column:
    """The Column of a formula; an unknown column or form of expression is refused."""

    def walk(node: ast.expr, depth: int = 0) -> Column:
        if depth > MOST_DEPTH:
            raise ValueError("the formula is nested too deeply")
        go = lambda n: walk(n, depth + 1)
        match node:
            case ast.Constant(value=bool() | int() | float() | str() as value):
                return F.lit(value)
            case ast.Name(id=name):
                if columns is not None and name not in columns:
                    raise ValueError(f"no such column: {name}")
                return F.col(f"`{name}`")
            case ast.BinOp(left=a, op=op, right=b) if type(op) in BINARY:
                return BINARY[type(op)](go(a), go(b))
            case ast.UnaryOp(op=ast.USub(), operand=a):
                return -go(a)
            case ast.UnaryOp(op=ast.Not(), operand=a):
                return ~go(a)
            case ast.BoolOp(op=op, values=values):
                out = go(values[0])
                for v in values[1:]:
                    out = out & go(v) if isinstance(op, ast.And) else out | go(v)
                return out
            case ast.Compare(left=a, ops=ops, comparators=others):
                out, left = None, go(a)
                for op, b in zip(ops, others, strict=True):
                    right = go(b)
                    one = COMPARE[type(op)](left, right)
                    out, left = one if out is None else out & one, right
                return out
            case ast.IfExp(test=c, body=a, orelse=b):
                return F.when(go(c), go(a)).otherwise(go(b))
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in FUNCTIONS:
                return FUNCTIONS[name](*map(go, args))
        raise ValueError(f"not allowed in a formula: {ast.unparse(node)}")

    return walk(parsed(text))
