"""Guard and invariant expressions: one grammar, evaluated in Python or compiled to a Spark column.

``or`` binds least, then ``and``, one comparison, sums, products, the signs ``!`` and ``-``, and calls, indices and
fields. Numbers are 64-bit and wrap; a :class:`U256` on either side makes the other one too, modulo 2^256.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+)|(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)|(?P<sign>\|\||&&|[=!<>]=|[<>!+\-*/%()\[\].,]))""")


class GuardError(ValueError):
    """An expression that does not parse or has no value."""


class U256(int):
    """An integer modulo 2^256."""

    def __new__(cls, value: int | str) -> U256:
        return super().__new__(cls, int(value) % (1 << 256))


@dataclass(frozen=True)
class Node:
    kind: str
    value: Any = None
    parts: tuple[Node, ...] = ()


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise GuardError(f"unexpected {text[at:].strip()[:1]!r} at {at}")
        at = m.end()
        out.append((m.lastgroup or "", m[m.lastgroup or 0]))
    return out


#: How strongly binary signs bind; comparisons do not chain.
_LEVELS = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5}
_WORDS = {"and": "&&", "or": "||", "not": "!"}


class _Parser:
    def __init__(self, text: str):
        self.tokens = [("sign", _WORDS[v]) if k == "name" and v in _WORDS else (k, v) for k, v in tokenize(text)]
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        kind, found = self.peek()
        if value is not None and found != value or kind == "end":
            raise GuardError(f"expected {value or 'a value'}, found {found or 'the end'}")
        self.at += 1
        return kind, found

    def binary(self, least: int) -> Node:
        left = self.unary()
        while True:
            kind, sign = self.peek()
            level = _LEVELS.get(sign, 0) if kind == "sign" else 0
            if level < least or not level:
                return left
            self.take()
            left = Node("binary", sign, (left, self.binary(level + 1)))
            if level == 3 and _LEVELS.get(self.peek()[1]) == 3:
                raise GuardError("comparisons do not chain")

    def unary(self) -> Node:
        kind, sign = self.peek()
        if kind == "sign" and sign in "!-":
            self.take()
            return Node("unary", sign, (self.unary(),))
        node = self.primary()
        while self.peek()[1] in ("[", ".", "(") and self.peek()[0] == "sign":
            _, sign = self.take()
            if sign == "[":
                node = Node("index", None, (node, self.binary(1)))
                self.take("]")
            elif sign == ".":
                kind, name = self.take()
                if kind != "name":
                    raise GuardError(f"no field {name}")
                node = Node("field", name, (node,))
            else:
                if node.kind != "name":
                    raise GuardError("only names are called")
                arguments = []
                while self.peek()[1] != ")":
                    arguments.append(self.binary(1))
                    if self.peek()[1] != ")":
                        self.take(",")
                self.take(")")
                node = Node("call", node.value, tuple(arguments))
        return node

    def primary(self) -> Node:
        kind, value = self.take()
        if kind == "number":
            return Node("literal", int(value))
        if kind == "text":
            return Node("literal", re.sub(r"\\(.)", r"\1", value[1:-1]))
        if kind == "name":
            return Node("literal", value == "true") if value in ("true", "false") else Node("name", value)
        if value == "(":
            node = self.binary(1)
            self.take(")")
            return node
        raise GuardError(f"unexpected {value}")


def parse(text: str) -> Node:
    parser = _Parser(text)
    node = parser.binary(1)
    if parser.peek()[0] != "end":
        raise GuardError(f"unexpected {parser.peek()[1]}")
    return node


def _wrapped(n: int) -> int:
    return (n + (1 << 63)) % (1 << 64) - (1 << 63)


def _number(v: Any) -> int | None:
    if isinstance(v, bool):
        return None
    if isinstance(v, (int, float)):
        return v if isinstance(v, U256) else int(v)
    if isinstance(v, str) and re.fullmatch(r"[+-]?\d+", v):
        return int(v)
    return None


def truth(v: Any) -> bool:
    if isinstance(v, (bool, int, float)):
        return bool(v)
    raise GuardError(f"{v!r} is no truth value")


def _arithmetic(sign: str, a: Any, b: Any) -> int:
    x, y = _number(a), _number(b)
    if x is None or y is None:
        raise GuardError(f"{a!r} {sign} {b!r} is no number")
    if sign in "/%" and y == 0:
        raise GuardError("division by zero")
    if sign == "+":
        out = x + y
    elif sign == "-":
        out = x - y
    elif sign == "*":
        out = x * y
    else:
        q = abs(x) // abs(y) * (1 if (x < 0) == (y < 0) else -1)
        out = q if sign == "/" else x - q * y
    return U256(out) if isinstance(a, U256) or isinstance(b, U256) else _wrapped(out)


def _compared(sign: str, a: Any, b: Any) -> bool:
    x, y = _number(a), _number(b)
    if x is None or y is None:
        if sign in ("==", "!="):
            return (a == b) == (sign == "==")
        if not (isinstance(a, str) and isinstance(b, str)):
            raise GuardError(f"{a!r} and {b!r} have no order")
        x, y = a, b
    return {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[sign]


def evaluate_node(node: Node, bindings: Mapping[str, Any], functions: Mapping[str, Callable]) -> Any:
    """The value of a parsed expression.

    A key that a map lacks reads as 0; a field that a record lacks, and unknown names and functions, are errors.
    """
    go = lambda n: evaluate_node(n, bindings, functions)
    if node.kind == "literal":
        return node.value
    if node.kind == "name":
        if node.value not in bindings:
            raise GuardError(f"unknown name {node.value}")
        return bindings[node.value]
    if node.kind == "call":
        if node.value not in functions:
            raise GuardError(f"unknown function {node.value}")
        return functions[node.value](*map(go, node.parts))
    if node.kind == "field":
        record = go(node.parts[0])
        if not isinstance(record, Mapping) or node.value not in record:
            raise GuardError(f"no field {node.value}")
        return record[node.value]
    if node.kind == "index":
        held, key = map(go, node.parts)
        if isinstance(held, Mapping):
            return held.get(key, held.get(str(key), 0))
        if isinstance(held, (list, tuple)) and isinstance(key, int) and 0 <= key < len(held):
            return held[key]
        raise GuardError(f"no index {key!r}")
    if node.kind == "unary":
        value = go(node.parts[0])
        return not truth(value) if node.value == "!" else _arithmetic("-", U256(0) if isinstance(value, U256) else 0, value)
    left = go(node.parts[0])
    if node.value == "&&":
        return truth(left) and truth(go(node.parts[1]))
    if node.value == "||":
        return truth(left) or truth(go(node.parts[1]))
    right = go(node.parts[1])
    return _compared(node.value, left, right) if _LEVELS[node.value] == 3 else _arithmetic(node.value, left, right)


def marking_functions(marking: Mapping[str, int]) -> dict[str, Callable]:
    """Aggregates over places by the start of their names."""
    of = lambda prefix: [n for p, n in marking.items() if p.startswith(prefix)]
    return {
        "sum": lambda prefix: sum(of(prefix)),
        "count": lambda prefix: sum(1 for n in of(prefix) if n > 0),
        "tokens": lambda place: marking.get(place, 0),
        "min": lambda prefix: min(of(prefix), default=0),
        "max": lambda prefix: max([0, *of(prefix)]),
    }


def evaluate(text: str, bindings: Mapping[str, Any] | None = None, functions: Mapping[str, Callable] | None = None) -> bool:
    """Whether a guard holds; an empty guard does."""
    if not text.strip():
        return True
    builtin = {"address": lambda n: f"0x{int(n):040x}"}
    return truth(evaluate_node(parse(text), bindings or {}, {**builtin, **(functions or {})}))


def holds(text: str, marking: Mapping[str, int]) -> bool:
    """Whether an invariant holds in a marking."""
    return evaluate(text, marking, marking_functions(marking))


def to_column(text: str, bindings: Mapping[str, Column] | None = None, marking: Column | None = None) -> Column:
    """A guard on 64-bit numbers, strings and maps as a column.

    Names are columns of the row unless ``bindings`` has them; the aggregates run over ``marking``, a map of tokens.
    """
    from . import statemap

    def go(n: Node) -> Column:
        if n.kind == "literal":
            return F.lit(n.value)
        if n.kind == "name":
            return (bindings or {}).get(n.value, F.col(n.value))
        if n.kind == "field":
            return go(n.parts[0]).getField(n.value)
        if n.kind == "index":
            return F.coalesce(F.try_element_at(go(n.parts[0]), go(n.parts[1])), F.lit(0))
        if n.kind == "call":
            if marking is None or n.value not in ("sum", "count", "tokens", "min", "max") or len(n.parts) != 1 or n.parts[0].kind != "literal":
                raise GuardError(f"unknown function {n.value}")
            name = n.parts[0].value
            if n.value == "tokens":
                return statemap.get(marking, name)
            field = {"sum": "total", "count": "places", "min": "least", "max": "most"}[n.value]
            return statemap.aggregates(marking, name)[field]
        if n.kind == "unary":
            return ~go(n.parts[0]) if n.value == "!" else -go(n.parts[0])
        a, b = map(go, n.parts)
        if n.value == "&&":
            return F.when(a, b).otherwise(F.lit(False))  # the right side is not reached where the left is false
        if n.value == "||":
            return F.when(a, F.lit(True)).otherwise(b)
        if n.value == "/":
            return F.floor(F.abs(a) / F.abs(b)).cast("long") * F.signum(a).cast("long") * F.signum(b).cast("long")
        return {"+": a + b, "-": a - b, "*": a * b, "%": a % b, "==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[n.value]

    return go(parse(text)) if text.strip() else F.lit(True)
