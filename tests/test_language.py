"""Parsing, typing, validation, identity."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewick.plans import formula as f

H001 = f.Constraints(
    allowed=frozenset({"zscore", "ret", "lag", "rolling_std", "sub", "mul", "in_window", "ref"}), forbidden=frozenset({"rank_ts"}), max_window=120, max_depth=4, max_nodes=12, max_free_params=3, required_symbols=frozenset({"ES"})
)
OPEN = f.Constraints()


@pytest.mark.parametrize("text", ['sub(close(), ref("ES"))', "add(close(), volume())", "gt(close(), volume())"])
def test_invalid(text):
    assert f.validate(f.parse(text), OPEN)[0] == "INVALID_AST"


def test_window_and_symbols():
    assert f.validate(f.parse("zscore(ret(close(),2), 500)"), OPEN) == ("INVALID_AST", "window 500")
    assert f.validate(f.parse("zscore(ret(close(),2), 55)"), H001)[0] == "INVALID_AST"


def test_good_and_complex():
    good = f.parse('mul(in_window("10:30","16:30"), sub(zscore(ret(ref("ES"),2),55), zscore(ret(close(),2),55)))')
    assert f.validate(good, H001) == (None, None)
    assert good.depth() == 4 and sum(1 for _ in good.walk()) == 9 and good.windows() == {2, 55}
    deep = f.parse("zscore(ema(ema(ema(ema(close(),2),2),2),2),3)")
    assert f.validate(deep, OPEN) == ("TOO_COMPLEX", None)
    assert f.lookback(good) == 56


@pytest.mark.parametrize("text", ["", "close", "close(", "foo()", "lag(close(), 1.5)", "lag(close(), k=1)", "3", "close() + 1"])
def test_not_parsed(text):
    with pytest.raises(f.ParseError):
        f.parse(text)


def test_json():
    assert f.from_json({"op": "lag", "args": [{"op": "close", "args": []}, 3]}) == f.parse("lag(close(),3)")
    with pytest.raises(f.ParseError):
        f.from_json({"op": "nope"})


def same(a, b):
    assert f.canonical(f.parse(a)) == f.canonical(f.parse(b))


def test_rules():
    same("add(close(),high())", "add(high(),close())")
    same("lt(close(),high())", "gt(high(),close())")
    same("lag(close(),0)", "close()")
    same("zscore(zscore(close(),5),5)", "zscore(close(),5)")
    same("div(mul(zscore(close(),5),zscore(high(),5)),zscore(high(),5))", "zscore(close(),5)")
    assert f.canonical(f.parse("sub(close(),close())")) == f.const(0, "Price")
    assert f.canonical(f.parse("add(high(),sub(close(),close()))")) == f.parse("high()")
    assert f.canonical(f.parse('mul(gt(const(2,"Z"),const(1,"Z")),zscore(close(),3))')) == f.parse("zscore(close(),3)")


def test_signatures():
    sig = lambda w: f.structural_signature(f.parse(f"zscore(close(),{w})"))
    assert sig(20) == sig(21) == sig(22) != sig(55)
    assert f.exact_signature(f.parse("zscore(close(),20)")) != f.exact_signature(f.parse("zscore(close(),21)"))
    assert f.structural_signature(f.parse("sub(zscore(close(),20),zscore(close(),21))")) == f.digest(f.const(0, "Z"))


def test_neighbours():
    good = f.parse("zscore(ret(close(),2),55)")
    assert [n.windows() for n in f.neighbours(good)] == [{1, 34}, {3, 89}]
    assert len(f.neighbours(f.parse("zscore(close(),144)"))) == 1


def grown(rng, unit, depth):
    """A random tree of a unit."""
    if depth == 0 or rng.random() < 0.15:
        leaf = {"Price": ["close()", "high()", 'ref("ES")'], "Volume": ["volume()", "minutes_since_open()"], "Bool": ['in_window("10:00","11:00")'], "Z": ["zscore(close(),5)"], "Return": ["ret(close(),1)"]}
        return f.parse(rng.choice(leaf[unit]))
    sub = lambda u: grown(rng, u, depth - 1)
    w = rng.choice([1, 2, 3, 5, 8, 20])
    if unit == "Bool":
        u = rng.choice(f.NUMERIC)
        return rng.choice([lambda: f.Node(rng.choice(["gt", "lt"]), (sub(u), sub(u))), lambda: f.Node(rng.choice(["and_", "or_"]), (sub("Bool"), sub("Bool")))])()
    choice = [lambda: f.Node(rng.choice(["add", "sub"]), (sub(unit), sub(unit))), lambda: f.Node(rng.choice(["lag", "delta", *f.ROLLING]), (sub(unit), w)), lambda: f.Node("mul", (sub("Bool"), sub(unit)))]
    if unit == "Z":
        choice += [lambda: f.Node("zscore", (sub(rng.choice(f.NUMERIC)), w)), lambda: f.Node("clip", (sub("Z"), -1, 2)), lambda: f.Node("mul", (sub("Z"), sub("Z")))]
    if unit == "Return":
        choice += [lambda: f.Node("div", (sub("Price"), sub("Price"))), lambda: f.Node("ret", (sub("Price"), w))]
    return rng.choice(choice)()


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 10**9))
def test_canonical_is_idempotent_and_keeps_the_unit(seed):
    n = grown(random.Random(seed), random.Random(seed + 1).choice(["Z", "Bool", "Price"]), 4)
    u = f.unit(n)
    c = f.canonical(n)
    assert f.canonical(c) == c and f.unit(c) == u
