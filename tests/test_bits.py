import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from emberflow.functions.effects import BIT
from emberflow.operators import bits as B
from emberflow.operators import verbs as V
from emberflow.operators.fixpoint import grow


def closure(pairs):
    """For each node all it reaches over at least one call."""
    after = defaultdict(set)
    for a, b in pairs:
        after[a].add(b)
    out = {}
    for n in {x for p in pairs for x in p}:
        seen, todo = set(), list(after[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after[x]
        out[n] = seen
    return out


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(8)
    pairs = {(f"a.n{rng.randrange(150)}", f"a.n{rng.randrange(150)}") for _ in range(190)}
    pairs |= {(f"a.r{i}", f"a.r{(i + 1) % 9}") for i in range(9)} | {("a.n3", "a.r0"), ("a.r4", "a.n77"), ("a.self", "a.self")}
    pairs |= {(f"a.c{i}", f"a.c{i + 1}") for i in range(12)}
    return sorted(pairs), spark.createDataFrame(sorted(pairs), "caller string, callee string")


def test_components_are_those_of_mutual_reach(graph):
    pairs, edges = graph
    reached = closure(pairs)
    found = {r["fn"]: r["comp"] for r in B.components(edges).collect()}
    assert len(found) == B.components(edges).count()
    same = lambda a, b: a == b or (b in reached[a] and a in reached[b])
    names = sorted(reached)
    for a in names:
        for b in names:
            assert (found.get(a, a) == found.get(b, b)) == same(a, b), (a, b)


def test_blindspots_count_all_that_reach_a_source(spark, graph):
    pairs, edges = graph
    reached = closure(pairs)
    whys = [(n, w) for i, n in enumerate(sorted(reached)) if i % 2 for w in (["reflect:x", "dispatch:a.B.c"] if i % 3 else ["native:y"])] + [("a.alone", "reflect:z")]
    got = {r["fn"]: (r["classes"], r["n_reach"]) for r in V.blindspots(edges, spark.createDataFrame(whys, "fn string, why string")).collect()}
    want = {fn: sum(1 for n, to in reached.items() if fn in to and n != fn) for fn, _ in whys}
    assert {fn: n for fn, (_, n) in got.items()} == want
    assert got["a.alone"] == ("reflect", 0)


def test_spread_and_counts_over_many_chunks(spark):
    """2,000 members in a chain of unions: sets are 64 members a row."""
    sets = spark.range(2000).select(F.concat(F.lit("s"), "id").alias("node"))
    seeds = B.numbered(sets)
    links = spark.range(2000).select(F.concat(F.lit("s"), "id").alias("src"), F.expr("concat('t', id % 10)").alias("dst")).union(spark.range(10).select(F.expr("concat('t', id)"), F.lit("top")))
    out = B.spread(links, seeds.select("node", "chunk", "mask"))
    top = out.filter("node = 'top'")
    assert B.members(top).count() == 2000 and top.count() <= 2000 / 64 + spark.sparkContext.defaultParallelism + 1
    n = B.weighed(out, F.lit(1))
    assert {(r["n"]) for r in n.collect()} == {3} and n.count() == 2000


def test_remedies_with_ten_thousand_sites(spark):
    """Two starts share a set of 10^4 sites, a third has half of it; the closure has a row for 64 sites, not for each."""
    n = 10_000
    db = BIT["Db"]
    sites = spark.range(n).select(F.format_string("x.s%05d", "id").alias("fn"), F.lit(db).alias("mask"), F.lit(db).alias("direct_mask"))
    rest = spark.createDataFrame([(f, db, 0) for f in ("api.a", "api.b", "api.c", "lib.all", "lib.half")], "fn string, mask int, direct_mask int")
    edges = spark.range(n).select(F.lit("lib.half").alias("caller"), F.format_string("x.s%05d", "id").alias("callee")).filter(f"callee < 'x.s{n // 2:05d}'")
    edges = edges.union(spark.range(n).select(F.lit("lib.all"), F.format_string("x.s%05d", "id"))).union(spark.createDataFrame([("api.a", "lib.all"), ("api.b", "lib.all"), ("api.c", "lib.half")], "caller string, callee string"))
    out = V.remedies(sites.union(rest), edges, "Db", F.startswith("fn", F.lit("api."))).collect()
    assert sorted((len(r["sites"]), r["n_starts"], r["n_span"], r["hoist"], r["n_higher"], r["clean"]) for r in out) == [(n // 2, 1, 0, ["lib.all", "lib.half"], 0, False), (n, 2, 0, ["lib.all", "lib.half"], 0, False)]
    assert next(r for r in out if len(r["sites"]) == n)["sites"] == [f"x.s{i:05d}" for i in range(n)]


def test_remedies_draw_together_cycles_below_denied_carriers_only(spark, monkeypatch):
    """A ring of 12 above the denied carrier is climbed but not condensed; one of two below it is."""
    seen, whole = [], V.components
    monkeypatch.setattr(V, "components", lambda calls, *a: seen.append(calls.count()) or whole(calls, *a))
    db, ring = BIT["Db"], [f"lib.r{i:02d}" for i in range(12)]
    names = [*ring, "dao.a", "x.b", "x.c"]
    f = spark.createDataFrame([(n, db, db if n == "x.c" else 0) for n in names], "fn string, mask int, direct_mask int")
    calls = [*zip(ring, ring[1:] + ring[:1]), (ring[0], "dao.a"), ("dao.a", "x.c"), ("x.b", "x.c"), ("x.c", "x.b"), ("ghost", "dao.a"), ("ghost", ring[3])]
    out = V.remedies(f, spark.createDataFrame(calls, "caller string, callee string"), "Db", F.startswith("fn", F.lit("dao."))).collect()
    assert [tuple(r) for r in out] == [(["x.c"], 1, 1, [ring[0], "x.b"], 12, False)]
    assert seen == [3]


def test_a_round_moves_what_is_new_only(spark, graph, monkeypatch):
    """The plan of a round shuffles neither the links nor what is known."""
    from emberflow.plans import runtime

    plans = []
    add = runtime.Kept.add

    def spy(self, rows):
        if self.rounds == 2:
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return add(self, rows)

    monkeypatch.setattr(runtime.Kept, "add", spy)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, edges = graph
        B.spread(edges.selectExpr("callee AS src", "caller AS dst"), B.numbered(edges.selectExpr("callee AS node").distinct()).select("node", "chunk", "mask")).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One exchange of what the links bring to callers, one of the new rows to the links they meet.
    assert plans and plans[0].count("Exchange hashpartitioning") <= 2, plans[0]


def test_rounds_are_bounded_and_tables_go(spark):
    edges = spark.createDataFrame([(f"f{i}", f"f{i + 1}") for i in range(30)], "caller string, callee string")
    step = lambda links, new, known: links.join(new.withColumnRenamed("fn", "callee"), "callee").select(F.col("caller").alias("fn"))
    first = spark.createDataFrame([("f30",)], "fn string")
    assert grow(edges, "callee", first, step, ["fn"]).count() == 31
    with pytest.raises(RuntimeError):
        grow(edges, "callee", first, step, ["fn"], rounds=5)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("emberflow")]
