"""Expressions over a panel: the tree and the parser.

``parse("Mean($close, 5) / Ref($close, 1) - 1")`` gives a tree of Field, PitField, Literal and Call. The text is
read with Python's own ``ast`` in expression mode against a whitelist; nothing is evaluated.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass


class ExpressionError(ValueError):
    """The text is not an expression of the language."""


@dataclass(frozen=True)
class Node:
    def __add__(self, other):
        return Call("Add", (self, lift(other)))

    def __radd__(self, other):
        return Call("Add", (lift(other), self))

    def __sub__(self, other):
        return Call("Sub", (self, lift(other)))

    def __rsub__(self, other):
        return Call("Sub", (lift(other), self))

    def __mul__(self, other):
        return Call("Mul", (self, lift(other)))

    def __rmul__(self, other):
        return Call("Mul", (self, lift(other)))

    def __truediv__(self, other):
        return Call("Div", (self, lift(other)))

    def __rtruediv__(self, other):
        return Call("Div", (lift(other), self))

    def __pow__(self, other):
        return Call("Power", (self, lift(other)))

    def __neg__(self):
        return Call("Mul", (Literal(-1), self))

    def __gt__(self, other):
        return Call("Gt", (self, lift(other)))

    def __ge__(self, other):
        return Call("Ge", (self, lift(other)))

    def __lt__(self, other):
        return Call("Lt", (self, lift(other)))

    def __le__(self, other):
        return Call("Le", (self, lift(other)))

    def __and__(self, other):
        return Call("And", (self, lift(other)))

    def __or__(self, other):
        return Call("Or", (self, lift(other)))


@dataclass(frozen=True)
class Field(Node):
    name: str

    def __str__(self):
        return f"${self.name}"


@dataclass(frozen=True)
class PitField(Node):
    name: str

    def __str__(self):
        return f"$${self.name}"


@dataclass(frozen=True)
class Literal(Node):
    value: float | int | str | bool | None

    def __str__(self):
        return repr(self.value)


@dataclass(frozen=True)
class Call(Node):
    op: str
    args: tuple[Node, ...]

    def __str__(self):
        return f"{self.op}({','.join(map(str, self.args))})"


def lift(x) -> Node:
    return x if isinstance(x, Node) else Literal(x)


BINARY = {ast.Add: "Add", ast.Sub: "Sub", ast.Mult: "Mul", ast.Div: "Div", ast.Pow: "Power", ast.BitAnd: "And", ast.BitOr: "Or"}
COMPARE = {ast.Gt: "Gt", ast.GtE: "Ge", ast.Lt: "Lt", ast.LtE: "Le", ast.Eq: "Eq", ast.NotEq: "Ne"}
PIT, PLAIN = "_pit_field_", "_field_"


def parse(text: str | Node, names: frozenset[str] | None = None) -> Node:
    """The tree of text. names: operators that exist; None: any."""
    if isinstance(text, Node):
        return text
    plain = re.sub(r"\$\$([A-Za-z_]\w*)", rf"{PIT}\1", text)
    plain = re.sub(r"\$([A-Za-z_]\w*)", rf"{PLAIN}\1", plain).strip()
    try:
        tree = ast.parse(plain, mode="eval").body
    except SyntaxError as e:
        raise ExpressionError(f"{text!r}: {e.msg}") from None

    def walk(node: ast.AST) -> Node:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float, str, bool, type(None))):
            return Literal(node.value)
        if isinstance(node, ast.Name):
            if node.id.startswith(PIT):
                return PitField(node.id.removeprefix(PIT))
            if node.id.startswith(PLAIN):
                return Field(node.id.removeprefix(PLAIN))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            inner = walk(node.operand)
            if isinstance(node.op, ast.UAdd):
                return inner
            return Literal(-inner.value) if isinstance(inner, Literal) and isinstance(inner.value, (int, float)) else -inner
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Invert):
            return Call("Not", (walk(node.operand),))
        if isinstance(node, ast.BinOp) and type(node.op) in BINARY:
            return Call(BINARY[type(node.op)], (walk(node.left), walk(node.right)))
        if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in COMPARE:
            return Call(COMPARE[type(node.ops[0])], (walk(node.left), walk(node.comparators[0])))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
            if names is not None and node.func.id not in names:
                raise ExpressionError(f"{text!r}: no operator {node.func.id}")
            return Call(node.func.id, tuple(walk(a) for a in node.args))
        raise ExpressionError(f"{text!r}: {ast.unparse(node)} is not part of the language")

    return walk(tree)


def fields_of(node: Node) -> set[str]:
    if isinstance(node, Field):
        return {node.name}
    return set().union(*map(fields_of, node.args)) if isinstance(node, Call) else set()
