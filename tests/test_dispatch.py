import random
from collections import defaultdict, deque

import pytest

from emberflow.operators import dispatch as H
from emberflow.operators import verbs as V


def frames(spark, sites, supers, methods):
    return spark.createDataFrame(sites, "site string, owner string, method string"), spark.createDataFrame(supers, "type string, super string, kind string, place int"), spark.createDataFrame(methods, "owner string, method string")


def test_a_superclass_comes_before_an_interface_however_far(spark):
    supers = [("C", "Base", "class", 1), ("Base", "Root", "class", 1), ("C", "AIface", "interface", 2), ("Root", "java.lang.Object", "class", 1), ("C2", "Base2", "class", 1), ("C2", "AIface", "interface", 2), ("D", "Base", None, 2), ("D", "AIface", None, 1)]
    out = H.dispatch(*frames(spark, [(s, s, "run") for s in ("C", "C2", "D", "E")], supers, [("Root", "run"), ("AIface", "run"), ("java.lang.Object", "run")])).collect()
    assert {r["site"]: (r["target"], r["how"]) for r in out} == {"C": ("Root.run", "inherited"), "C2": ("AIface.run", "inherited"), "D": ("AIface.run", "inherited"), "E": (None, "none")}


def order(start, supers):
    """The two queues, plainly."""
    of = defaultdict(list)
    for t, s, kind, place in sorted(supers, key=lambda x: x[3]):
        of[t].append((s, kind))
    out, seen, classes, interfaces = [], set(), deque([start]), deque()
    while classes or interfaces:
        first = bool(classes)
        t = (classes if first else interfaces).popleft()
        if t in seen:
            continue
        seen.add(t)
        out.append(t)
        for s, kind in of[t]:
            (classes if first and kind != "interface" else interfaces).append(s)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_inherited_bodies_follow_the_two_queues(spark, seed):
    rng = random.Random(seed)
    supers = [(f"C{i}", f"C{rng.randrange(i)}", "class", 1) for i in range(1, 40) if rng.random() < 0.8]
    supers += [(f"C{i}", f"I{j}", "interface", 2 + k) for i in range(40) for k, j in enumerate(rng.sample(range(25), rng.randrange(4)))]
    supers += [(f"I{i}", f"I{j}", "interface", k) for i in range(1, 25) for k, j in enumerate(rng.sample(range(i), min(i, rng.randrange(3))))]
    supers += [(f"U{i}", f"{rng.choice('CI')}{rng.randrange(20)}", None, k) for i in range(15) for k in range(2)]
    methods = [(t, m) for t in [f"C{i}" for i in range(8)] + [f"I{i}" for i in range(25)] for m in ("a", "b") if rng.random() < 0.3]
    sites = [(f"{t}:{m}", t, m) for t in [f"C{i}" for i in range(40)] + [f"U{i}" for i in range(15)] for m in ("a", "b")]
    _, s, b = frames(spark, sites, supers, methods)
    asked = spark.createDataFrame([(t, m) for _, t, m in sites if (t, m) not in methods], "owner string, method string")
    got = {(r["owner"], r["method"]): r["node"] for r in H.inherited(asked, s, b).collect()}
    want = {}
    for _, t, m in sites:
        if (t, m) not in methods and (hit := [x for x in order(t, supers) if (x, m) in methods]):
            want[t, m] = hit[0]
    assert got == want


def test_closed_owners_exceed_the_bound_and_others_stop_at_it(spark):
    supers = [(f"{o}{i}", o if i < 5 else f"{o}{i - 5}", "class", 1) for o in ("Open", "Enum", "Sealed") for i in range(20)]
    methods = [(f"{o}{i}", "run") for o in ("Open", "Enum", "Sealed") for i in range(20)] + [("Few1", "run"), ("Few", "run")]
    sites = [(o, o, "run") for o in ("Open", "Enum", "Sealed", "Few", "Gap")]
    hierarchy = spark.createDataFrame([("Enum", True, False), ("Sealed", False, True), ("Gap", False, True)], "type string, closed boolean, unseen boolean")
    s = frames(spark, sites, [*supers, ("Few1", "Few", "class", 1)], methods)
    out = defaultdict(list)
    for r in H.dispatch(*s, hierarchy).collect():
        out[r["site"]].append((r["target"], r["how"], r["complete"]))
    assert out["Open"] == [(None, "wide", False)] and out["Sealed"] == [(None, "wide", False)]
    assert len(out["Enum"]) == 20 and all(h == "below" and c for _, h, c in out["Enum"])
    assert sorted(out["Few"]) == [("Few.run", "below", True), ("Few1.run", "below", True)] and out["Gap"] == [(None, "none", False)]
    assert V.dispatch_targets(*s).filter("site in ('Open', 'Enum')").count() == 0
