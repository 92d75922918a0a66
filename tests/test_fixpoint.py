"""Small call graphs with known answers, and invariants of closures."""

import pytest
from pyspark.sql import functions as F

from emberflow.functions.effects import BIT, mask_of, names_of
from emberflow.operators import verbs as V
from emberflow.operators.fixpoint import effect_fixpoint, shortest_paths, value_fixpoint


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def inferred(spark, edges, direct):
    e = frame(spark, edges, "caller string, callee string")
    d = frame(spark, [(f, mask_of(x)) for f, x in direct], "fn string, mask int")
    return {r["fn"]: set(r["n"]) for r in effect_fixpoint(e, d).select("fn", names_of(F.col("mask")).alias("n")).collect()}


@pytest.mark.parametrize(
    "edges, direct, want",
    [
        ([("a", "b"), ("b", "c")], [("c", ["Fs"])], {"a": {"Fs"}, "b": {"Fs"}, "c": {"Fs"}}),
        ([("caller", "x"), ("caller", "y")], [("x", ["Net"]), ("y", ["Db"])], {"caller": {"Db", "Net"}, "x": {"Net"}, "y": {"Db"}}),
        ([("user", "X"), ("X", "deep")], [("X", ["Log"]), ("deep", ["Net"])], {"user": {"Log", "Net"}, "X": {"Log", "Net"}, "deep": {"Net"}}),
        ([("a", "b"), ("b", "a")], [("a", ["Fs"])], {"a": {"Fs"}, "b": {"Fs"}}),
        ([("a", "b")], [], {}),
    ],
)
def test_effects(spark, edges, direct, want):
    assert inferred(spark, edges, direct) == want


def functions(spark, edges, direct, names=()):
    e = frame(spark, edges, "caller string, callee string")
    d = frame(spark, [(f, mask_of(x)) for f, x in direct], "fn string, mask int")
    every = sorted({x for p in edges for x in p} | {f for f, _ in direct} | set(names))
    n = frame(spark, [(x,) for x in every], "fn string")
    rows = n.join(effect_fixpoint(e, d), "fn", "left").join(d.select("fn", F.col("mask").alias("direct_mask")), "fn", "left")
    return e, rows.select("fn", F.coalesce("mask", F.lit(0)).alias("mask"), F.coalesce("direct_mask", F.lit(0)).alias("direct_mask"), F.lit(False).alias("entry_point"))


def test_callers_lists_the_target_only_on_a_cycle(spark):
    e = frame(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("d", "a")], "caller string, callee string")
    got = {r["fn"]: r["hops"] for r in V.callers(e, "b").collect()}
    assert got == {"a": 1, "c": 1, "b": 2, "d": 2}
    assert {r["fn"] for r in V.callers(e, "a").collect()} == {"d"}


def test_values_close_over_cycles(spark):
    e = frame(spark, [("a", "b"), ("b", "a"), ("b", "c")], "caller string, callee string")
    got = value_fixpoint(e, frame(spark, [("c", "x"), ("a", "y"), ("a", "y")], "fn string, value string"))
    assert sorted(map(tuple, got.collect())) == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", "x")]


def test_paths_go_by_names_and_a_source_is_its_own_path(spark):
    e = frame(spark, [("s", "m2"), ("s", "m1"), ("m1", "z"), ("m2", "a"), ("a", "s")], "caller string, callee string")
    one = lambda *x: frame(spark, [(y,) for y in x], "fn string")
    got = shortest_paths(e, one("s", "z"), one("s", "m1", "m2", "z", "a"), one("z", "a"))
    assert sorted(map(tuple, got.collect())) == [("s", 0, "s"), ("s", 1, "m1"), ("s", 2, "z"), ("z", 0, "z")]


def test_tour_prefers_benign_deep_reaches(spark):
    e, f = functions(spark, [("settings.Settings.load", "core.refresh"), ("core.refresh", "core.steady"), ("core.steady", "netLayer.doSend"), ("api.fetch", "netLayer.doSend")], [("netLayer.doSend", ["Net"])])
    top = V.tour(f, e, ("Net",), 10).collect()
    assert (top[0]["fn"], top[0]["effect"], top[0]["hops"]) == ("settings.Settings.load", "Net", 3)
    assert "api.fetch" not in {r["fn"] for r in top}


def test_remedy_of_the_order_flow(spark):
    q = ["of.api.Api.getQuote", "of.domain.Pricing.quoteBulk", "of.domain.Pricing.priceQuote", "of.infra.Rates.fetchRate"]
    e, f = functions(spark, list(zip(q, q[1:])), [(q[3], ["Net"])])
    got = {k: sorted(r[0] for r in d.collect()) for k, d in V.remedy(f, e, "Net", F.col("fn").contains(".domain."), q[1]).items()}
    assert got == {"sites": [q[3]], "span": sorted(q[1:3]), "hoist": [q[0]], "higher": [], "sandwiched": [False]}


def test_containment_leak(spark):
    _, f = functions(spark, [], [("x.dao.Repo.load", ["Db"]), ("x.model.Order.save", ["Db"])])
    _, b = functions(spark, [], [("x.dao.Repo.load", ["Db"]), ("x.legacy.Old.load", ["Db"])])
    assert sorted(map(tuple, V.leaks(f, b, 1).collect())) == [("Db", "legacy", "improvement"), ("Db", "model", "leak")]
    assert V.containment(f, 1).first().asDict() == {"effect": "Db", "owner": "dao", "n_layers": 2, "n_total": 2, "share": 50}
    assert V.common_prefix(f) == 1


def test_nothing_changed_is_no_difference(spark):
    e, f = functions(spark, [("a", "b")], [("b", ["Fs"])])
    assert V.diff(f, f).count() == 0 and V.rewire(e, e).count() == 0 and V.gains(f, f).count() == 0


def test_where_parts_direct_and_inherited(spark):
    _, f = functions(spark, [("a", "b")], [("b", ["Fs"])], ["pure"])
    assert V.where(f).first().asDict() == {"effect": "Fs", "n_direct": 1, "n_inherited": 1}


def test_verify_discloses_unknown_and_finds_violations(spark):
    f = frame(spark, [("a", BIT["Net"]), ("b", BIT["Unknown"])], "fn string, mask int")
    o = frame(spark, [("a", "Net"), ("b", "Fs"), ("c", "Exec"), ("a", "Log")], "fn string, effect string")
    assert {r["fn"]: r["verdict"] for r in V.verify(o, f).collect()} == {"a": "clean", "b": "disclosed", "c": "violation"}


def test_remedies_of_all_starts_at_once(spark):
    q = ["of.api.Api.getQuote", "of.domain.Pricing.quoteBulk", "of.domain.Pricing.priceQuote", "of.infra.Rates.fetchRate"]
    e, f = functions(spark, [*zip(q, q[1:]), ("of.api.Web.page", q[0]), ("of.domain.Top.go", "of.api.Web.page")], [(q[3], ["Net"])])
    r = V.remedies(f, e, "Net", F.col("fn").contains(".domain.")).collect()
    assert [tuple(x) for x in r] == [([q[3]], 3, 2, [q[0]], 1, False)]


def test_rounds_leave_out_what_nobody_calls(spark, monkeypatch):
    """A thousand callers of a chain take their effects and values in the last step, and are in no round."""
    from emberflow.plans import runtime

    tops = [(f"t{i:03d}", "a") for i in range(1000)]
    # t000 performs an effect itself, and only it calls z, which calls nothing.
    edges = frame(spark, [*tops, ("a", "b"), ("b", "a"), ("b", "c"), ("t000", "z")], "caller string, callee string")
    rows, write = [], runtime.Kept._write
    monkeypatch.setattr(runtime.Kept, "_write", lambda self, df: rows.append(write(self, df)) or rows[-1])
    direct = frame(spark, [("c", BIT["Db"]), ("a", BIT["Fs"]), ("t000", BIT["Log"]), ("z", BIT["Net"])], "fn string, mask int")
    got = {r["fn"]: r["mask"] for r in effect_fixpoint(edges, direct).collect()}
    both = BIT["Db"] | BIT["Fs"]
    assert got == {**{t: both for t, _ in tops}, "t000": both | BIT["Log"] | BIT["Net"], "a": both, "b": both, "c": BIT["Db"], "z": BIT["Net"]}
    values = value_fixpoint(edges, direct.select("fn", F.col("mask").cast("string").alias("value"))).groupBy("fn").count().collect()
    assert {r["fn"]: r["count"] for r in values} == {f: m.bit_count() for f, m in got.items()}
    assert max(rows) < 10


def test_one_walk_carries_what_only_some_calls_pass(spark):
    """Low bits go along all calls, high ones along old calls only, as two walks would have it; a core may hold more calls."""
    rows = [("t", "a", True), ("u", "a", False), ("a", "b", True), ("b", "a", True), ("b", "c", False), ("c", "d", True)]
    edges = frame(spark, rows, "caller string, callee string, old boolean")
    low, high = frame(spark, [("d", 1), ("a", 2)], "fn string, mask long"), frame(spark, [("d", 4), ("b", 8)], "fn string, mask long")
    passed = F.when(F.col("old"), F.col("mask")).otherwise(F.col("mask").bitwiseAND(3))
    want: dict[str, int] = {}
    for e, d in ((edges, low), (edges.filter("old"), high)):
        for r in effect_fixpoint(e.select("caller", "callee"), d).collect():
            want[r["fn"]] = want.get(r["fn"], 0) | r["mask"]
    for core in (None, edges.filter("caller <> 't'")):
        assert {r["fn"]: r["mask"] for r in effect_fixpoint(edges, low.unionByName(high), core=core, passed=passed).collect()} == want


def test_the_model_walks_once_for_effects_classes_and_baseline(spark, monkeypatch):
    from emberflow.plans import views

    walks, walk = [], views.effect_fixpoint
    monkeypatch.setattr(views, "effect_fixpoint", lambda *a, **k: walks.append(1) or walk(*a, **k))
    monkeypatch.setattr(views, "_kept", {})
    m = views.Model(spark, "/root/testdata/sf0.001")
    for rows in (m.inferred(), m.base_inferred(), m.reason_classes(), m.gate_rows()):
        assert rows.count()
    assert len(walks) == 1
    before = effect_fixpoint(m.base_edges(), m.masks(True)).filter("mask <> 0")
    assert {tuple(r) for r in m.base_inferred().collect()} == {tuple(r) for r in before.collect()}


def test_effects_need_no_calls_by_customers_and_only_rules_no_effects(spark, monkeypatch):
    """The distinct calls of customers are made for questions about calls only, and gate_only walks no effects."""
    from emberflow.plans import queries, views

    monkeypatch.setattr(views, "_kept", {})
    m = views.Model(spark, "/root/testdata/sf0.001")
    assert queries.QUERIES["gate_only"](spark, m.sf_dir).count()
    assert {what for *_, what in views._kept} == {"core"}
    got = {tuple(r) for r in m.facts().collect()}
    assert "calls" not in {what for *_, what in views._kept}
    calls, plain = m.edges(), effect_fixpoint(m.edges().select("caller", "callee"), m.masks())
    assert {tuple(r) for r in calls.filter("caller not like 'app.api.%'").collect()} == {tuple(r) for r in m._core().collect()}
    effects = (1 << 16) - 1
    assert {(f, x & effects) for f, x in got if x & effects} == {(r["fn"], r["mask"]) for r in plain.filter("mask <> 0").collect()}
