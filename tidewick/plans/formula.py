"""The formula language: trees, typing, validation and identity.

A formula such as ``sub(zscore(close(), 55), zscore(ref("ES"), 55))`` is a call
expression; it is read with Python's own parser. Trees are never evaluated here:
``tidewick.plans.compiler`` turns them into columns.
"""

from __future__ import annotations

import ast as python_ast
import hashlib
from dataclasses import dataclass, field

from tidewick.functions.scalar import BUCKETS

PRICE, RETURN, VOLUME, Z, BOOL = "Price", "Return", "Volume", "Z", "Bool"
NUMERIC = (PRICE, RETURN, VOLUME, Z)
SERIES = {"close": PRICE, "high": PRICE, "low": PRICE, "vwap": PRICE, "volume": VOLUME, "trades": VOLUME}
ROLLING = ("rolling_mean", "rolling_std", "rolling_max", "rolling_min", "ema")
WINDOWED = ("lag", "delta", "ret", *ROLLING, "zscore", "rank_ts")
COMMUTE = ("add", "mul", "and_", "or_")
PAIRS = ("add", "sub", "mul", "div", "gt", "lt", "and_", "or_")
SYMBOLS = ("ES", "WDO")
#: n a formula, w a window, i an integer, s a text.
SHAPES = {**dict.fromkeys(SERIES, ""), **dict.fromkeys(WINDOWED, "nw"), **dict.fromkeys(PAIRS, "nn"), "ref": "s", "clip": "nii", "in_window": "ss", "minutes_since_open": "", "const": "is"}
OPERATORS = tuple(SHAPES)
REWRITES = 10_000


class FormulaError(Exception):
    """Any error of the language."""


class ParseError(FormulaError):
    """The text is no formula."""


class TypingError(FormulaError):
    """Units or arguments do not fit."""


class RewriteError(FormulaError):
    """The rewriting did not end."""


class MarketDataError(FormulaError):
    """The bars lack what the formula needs."""


@dataclass(frozen=True)
class Node:
    op: str
    args: tuple = ()

    def children(self) -> list[Node]:
        return [a for a in self.args if isinstance(a, Node)]

    def walk(self):
        yield self
        for c in self.children():
            yield from c.walk()

    def depth(self) -> int:
        return max((1 + c.depth() for c in self.children()), default=0)

    def windows(self) -> set[int]:
        return {n.args[1] for n in self.walk() if n.op in WINDOWED}

    def symbols(self) -> set[str]:
        return {n.args[0] for n in self.walk() if n.op == "ref"}

    def __str__(self) -> str:
        return "(" + " ".join([self.op, *(f'"{a}"' if isinstance(a, str) else str(a) for a in self.args)]) + ")"


def parse(text: str) -> Node:
    try:
        tree = python_ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError) as e:
        raise ParseError(str(e)) from None

    def read(x):
        match x:
            case python_ast.Call(func=python_ast.Name(id=name), args=args, keywords=[]) if name in SHAPES:
                return Node(name, tuple(read(a) for a in args))
            case python_ast.Constant(value=int() | str() as v) if not isinstance(v, bool):
                return v
            case python_ast.UnaryOp(op=python_ast.USub(), operand=python_ast.Constant(value=int() as v)):
                return -v
        raise ParseError(f"not a formula: {python_ast.unparse(x)[:60]}")

    out = read(tree)
    if not isinstance(out, Node):
        raise ParseError("a formula is a call of an operator")
    return out


def from_json(x: dict, depth: int = 64) -> Node:
    """A tree from {"op": name, "args": [...]}."""
    if not isinstance(x, dict) or x.get("op") not in SHAPES or depth < 0:
        raise ParseError("not a formula object")
    return Node(x["op"], tuple(from_json(a, depth - 1) if isinstance(a, dict) else a for a in x.get("args", [])))


def minutes(hhmm: str) -> int:
    h, _, m = hhmm.partition(":")
    if not (len(hhmm) == 5 and h.isdigit() and m.isdigit() and int(h) < 24 and int(m) < 60):
        raise TypingError(f"not a time of day: {hhmm!r}")
    return 60 * int(h) + int(m)


def check_shape(n: Node) -> None:
    for x in n.walk():
        kinds = {"n": Node, "w": int, "i": int, "s": str}
        shape = SHAPES[x.op]
        if len(shape) != len(x.args) or any(not isinstance(a, kinds[k]) or isinstance(a, bool) for a, k in zip(x.args, shape, strict=True)):
            raise TypingError(f"{x.op} takes {shape or 'nothing'}")
        if x.op == "in_window" and minutes(x.args[0]) >= minutes(x.args[1]):
            raise TypingError("the window ends before it starts")
        if x.op == "ref" and x.args[0] not in SYMBOLS:
            raise TypingError(f"unknown symbol {x.args[0]}")
        if x.op == "clip" and x.args[1] > x.args[2]:
            raise TypingError("clip bounds are the wrong way round")


def unit(n: Node) -> str:
    u = [unit(c) for c in n.children()]

    def need(ok: bool, out: str) -> str:
        if not ok:
            raise TypingError(f"{n.op} does not take {' and '.join(u)}")
        return out

    op = n.op
    if op in SERIES:
        return SERIES[op]
    if op in ("ref", "minutes_since_open", "in_window", "const"):
        return {"ref": PRICE, "minutes_since_open": VOLUME, "in_window": BOOL}.get(op) or n.args[1]
    if op == "lag":
        return u[0]
    if op == "ret":
        return need(u[0] == PRICE, RETURN)
    if op in ("zscore", "rank_ts"):
        return need(u[0] in NUMERIC, Z)
    if op in ("delta", *ROLLING):
        return need(u[0] in NUMERIC, u[0])
    if op == "clip":
        return need(u[0] == Z, Z)
    a, b = u
    if op in ("add", "sub"):
        return need(a == b and a in NUMERIC, a)
    if op in ("gt", "lt"):
        return need(a == b and a in NUMERIC, BOOL)
    if op in ("and_", "or_"):
        return need(a == b == BOOL, BOOL)
    if op == "mul":
        return b if a == BOOL else a if b == BOOL else need(a == b == Z, Z)
    return need(a == b and a in (PRICE, VOLUME, Z), Z if a == Z else RETURN)


@dataclass(frozen=True)
class Constraints:
    allowed: frozenset = frozenset(OPERATORS)
    forbidden: frozenset = frozenset()
    max_window: int = 120
    max_depth: int = 4
    max_nodes: int = 12
    max_free_params: int = 3
    required_symbols: frozenset = field(default_factory=frozenset)


def validate(n: Node, c: Constraints = Constraints()) -> tuple[str | None, str | None]:
    """(None, None) if the tree is valid, else its verdict and, for INVALID_AST, why. The checks run in a fixed order."""
    used = {x.op for x in n.walk()}
    if "const" in used or (refused := {o for o in used if o in c.forbidden or o not in c.allowed and o not in SERIES}):
        return "INVALID_AST", "operators: " + ", ".join(sorted({"const"} if "const" in used else refused))
    try:
        check_shape(n)
        root = unit(n)
    except TypingError as e:
        return "INVALID_AST", str(e)
    if root not in (Z, BOOL):
        return "INVALID_AST", f"the root is {root}"
    if wrong := [w for w in n.windows() if not 1 <= w <= c.max_window]:
        return "INVALID_AST", f"window {wrong[0]}"
    if missing := c.required_symbols - n.symbols():
        return "INVALID_AST", f"missing {sorted(missing)}"
    if n.depth() > c.max_depth or sum(1 for _ in n.walk()) > c.max_nodes or len(n.windows()) > c.max_free_params:
        return "TOO_COMPLEX", None
    return None, None


def lookback(n: Node) -> int:
    """Rows before the first value."""
    below = max((lookback(c) for c in n.children()), default=0)
    if n.op in ("lag", "delta", "ret"):
        return n.args[1] + below
    return below + (n.args[1] - 1 if n.op in WINDOWED else 0)


# Identity. Canonical trees serve comparison only; some rules do not keep values.


def digest(n) -> str:
    return hashlib.sha256((f'"{n}"' if isinstance(n, str) else str(n)).encode()).hexdigest()


def number(n) -> int | None:
    return n.args[0] if isinstance(n, Node) and n.op == "const" else None


def const(v: int, u: str) -> Node:
    return Node("const", (v, u))


def of_constant_window(n: Node):
    if n.op in WINDOWED and number(n.args[0]) is not None:
        return n.args[0] if n.op in ("lag", "rolling_mean", "rolling_max", "rolling_min", "ema") else const(0, unit(n))
    if n.op == "clip" and (v := number(n.args[0])) is not None:
        return const(sorted((n.args[1], v, n.args[2]))[1], Z)
    return None


def of_two_constants(n: Node):
    if n.op not in PAIRS or None in (v := [number(a) for a in n.args]):
        return None
    a, b = v
    known = {"add": a + b, "sub": a - b, "mul": a * b, "gt": int(a > b), "and_": int(a != 0 and b != 0), "or_": int(a != 0 or b != 0)}
    return const(known[n.op], unit(n)) if n.op in known else None


def of_neutral(n: Node):
    if n.op in ("add", "sub"):
        if number(n.args[1]) == 0:
            return n.args[0]
        return n.args[1] if n.op == "add" and number(n.args[0]) == 0 else None
    if n.op == "mul":
        if 0 in map(number, n.args):
            return const(0, unit(n))
        for one, other in (n.args, n.args[::-1]):
            if one == const(1, BOOL):
                return other
    return None


def of_same(n: Node):
    if n.op == "sub" and n.args[0] == n.args[1]:
        return const(0, unit(n.args[0]))
    if n.op == "lag" and n.args[1] == 0:
        return n.args[0]
    if n.op == "zscore" and n.args[0].op == "zscore" and n.args[0].args[1] == n.args[1]:
        return n.args[0]
    if n.op == "div" and n.args[0].op == "mul" and n.args[1] in n.args[0].args:
        a, b = n.args[0].args
        rest = a if b == n.args[1] else b
        return rest if unit(rest) == unit(n) else None  # a truth value over a price is a return, no truth value
    return None


def of_order(n: Node):
    if n.op == "lt":
        return Node("gt", n.args[::-1])
    if n.op in COMMUTE and digest(n.args[0]) > digest(n.args[1]):
        return Node(n.op, n.args[::-1])
    return None


RULES = (of_order, of_same, of_constant_window, of_two_constants, of_neutral)


def canonical(n: Node) -> Node:
    """Children first, then rules at the top until none applies."""
    left = REWRITES

    def settle(x: Node) -> Node:
        nonlocal left
        x = Node(x.op, tuple(settle(a) if isinstance(a, Node) else a for a in x.args))
        while (y := next((y for rule in RULES if (y := rule(x)) is not None), None)) is not None:
            left -= 1
            if left <= 0:
                raise RewriteError("no fixed point")
            x = y
        return x

    return settle(n)


def nearest(w: int) -> int:
    return min(BUCKETS, key=lambda b: (abs(b - w), b))


def with_windows(n: Node, f) -> Node:
    args = tuple(with_windows(a, f) if isinstance(a, Node) else a for a in n.args)
    return Node(n.op, (args[0], f(args[1])) if n.op in WINDOWED else args)


def exact_signature(n: Node) -> str:
    return digest(canonical(n))


def structural_signature(n: Node) -> str:
    """The same for trees whose windows fall in the same buckets."""
    return digest(canonical(with_windows(canonical(n), nearest)))


def neighbours(n: Node) -> list[Node]:
    """All windows a bucket lower, and all a bucket higher, where that changes the tree."""
    out = []
    for step in (-1, 1):
        at = lambda w, s=step: BUCKETS[min(max(BUCKETS.index(nearest(w)) + s, 0), len(BUCKETS) - 1)]
        v = with_windows(n, at)
        if v != n and v not in out:
            out.append(v)
    return out
