import random

import pytest

from emberflow.functions.effects import BIT
from emberflow.operators.disclosure import UNKNOWN, disclose
from emberflow.operators.fixpoint import effect_fixpoint
from emberflow.operators.unions import union_rows


@pytest.mark.parametrize("seed", [1, 2])
def test_disclosure_goes_on_until_no_call_is_added(spark, seed):
    rng = random.Random(seed)
    name = lambda: f"f{rng.randrange(40)}"
    edges = {(name(), name()) for _ in range(45)}
    sites = {(name(), f"i{rng.randrange(3)}", name()) for _ in range(25)}
    own = {f"f{i}": rng.choice([1, 2, 4, UNKNOWN]) for i in range(40) if rng.random() < 0.2}

    def close(mask):
        while True:
            new = dict(mask)
            for a, b in edges:
                new[a] = new.get(a, 0) | mask.get(b, 0)
            if new == mask:
                return mask
            mask = new

    mask, want = close(own), set()
    for turn in range(1, 100):
        due = [(c, v) for c, v, b in sites if mask.get(b, 0) & ~mask.get(c, 0) and not any(w[:2] == (c, v) for w in want)]
        # A call is a case again only by a body that has become Unknown since.
        if not due:
            break
        want |= {(c, v, turn) for c, v in due}
        mask = close({**mask, **{c: mask.get(c, 0) | UNKNOWN for c, _ in due}})
        sites = {s for s in sites if not mask.get(s[0], 0) & UNKNOWN}
    e = spark.createDataFrame(sorted(edges), "caller string, callee string")
    rng2 = random.Random(seed)
    name2 = lambda: f"f{rng2.randrange(40)}"
    [(name2(), name2()) for _ in range(45)]
    again = {(name2(), f"i{rng2.randrange(3)}", name2()) for _ in range(25)}
    inferred = effect_fixpoint(e, spark.createDataFrame(sorted(own.items()), "fn string, mask int"))
    rows, cases = disclose(e, inferred, spark.createDataFrame(sorted(again), "caller string, via string, body string"))
    assert {r["fn"]: r["mask"] for r in rows.collect()} == {f: m for f, m in mask.items() if m}
    assert {(r["caller"], r["why"].removeprefix("dispatch:"), r["turn"]) for r in cases.collect()} == want


def test_union_rows_of_three_arms(spark):
    net, db, fs, unknown = (BIT[e] for e in ("Net", "Db", "Fs", "Unknown"))
    types = [("app.I", True), ("app.A", False), ("app.B", False), ("app.C", False), ("app.None", True), ("app.Pure", True), ("app.P", False)]
    supers = [("app.B", "app.I"), ("app.C", "app.B"), ("app.B", "app.A"), ("app.B", "ext.api.Port"), ("app.B", "java.util.List"), ("app.B", "NoPackage"), ("app.P", "app.Pure"), ("app.B", "java.lang.Object")]
    methods = [("app.I", "go", False, fs), ("app.A", "go", True, 0), ("app.B", "go", False, net), ("app.C", "go", False, db), ("app.None", "go", True, 0), ("app.Pure", "go", True, 0), ("app.P", "go", False, 0), ("app.B", "toString", False, net), ("app.B", "<init>", False, net)]
    lambdas = [("ext.api.Port", "go", "app.l1", fs), ("ext.api.Fun", "call", "app.l2", net), ("java.util.Fun", "call", "app.l3", net), ("app.I", "go", "app.l4", db)] + [("ext.api.Many", "call", f"app.m{i}", net) for i in range(13)]
    frames = [spark.createDataFrame(x, s) for x, s in ((types, "type string, interface boolean"), (supers, "type string, super string"), (methods, "owner string, method string, abstract boolean, mask int"), (lambdas, "owner string, method string, fn string, mask int"), ([("java",)], "package string"), ([("app.A",)], "type string"))]
    got = {r["fn"]: tuple(r)[1:] for r in union_rows(*frames).collect()}
    assert got == {
        "app.I.go": ("own", fs | net | db, 3, 1, None, True),
        "app.A.go": ("own", net | db, 2, 0, None, False),
        "app.Pure.go": ("own", 0, 1, 0, None, False),
        "ext.api.Port.go": ("foreign,lambda", net | db | fs, 2, 1, None, False),
        "ext.api.Fun.call": ("lambda", net, 0, 1, None, False),
        "ext.api.Many.call": ("lambda", unknown, 0, 13, "dispatch:ext.api.Many.call", False),
    }
    few = {r["fn"]: tuple(r)[1:] for r in union_rows(*frames, most=2).collect()}
    assert few["app.I.go"] == ("own", unknown, 3, 1, "dispatch:app.I.go", True) and few["app.A.go"][1] == net | db, "closed owners aren't bounded"
    assert few["ext.api.Port.go"] == ("foreign,lambda", net | db | unknown, 2, 1, "dispatch:ext.api.Port.go", False), "lambdas beyond the bound add Unknown and delete nothing"
