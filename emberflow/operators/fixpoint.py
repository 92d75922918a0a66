"""Recursion over cyclic call graphs: semi-naive loops of joins, each round written to the shared folder.

Frames: edges (caller, callee). Every loop ends when a round finds nothing new, and raises an error after `rounds`
rather than give a partial answer. Only what is new takes part in the next join; a round is one job. The links of a
walk and what it has found lie in bucketed tables, by the columns they are joined on, so that neither is moved again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberflow.plans.runtime import Kept, bucketed, buckets, counted, shuffles, stored

ROUNDS = 500
#: Rounds after which buckets are merged, so that a late round doesn't open as many files as there were rounds.
APART = 8


def grow(links: DataFrame, key: str, first: DataFrame, step: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], on: list[str], rounds: int = ROUNDS, had: DataFrame | None = None) -> DataFrame:
    """All rows of first and of what step(links, new, known) adds round by round, until it adds nothing.

    Steps join what is new with links on key, and hold what they get against known on the columns `on`. Both lie in
    buckets by these columns, so a round shuffles what is new and never the links or what is known. had: rows that are
    known from the start and not new; they are part of the result.
    """
    links, n_links = counted(links)
    first, n_first = counted(first)
    n = buckets(first.sparkSession, n_links + n_first)
    dealt, known = bucketed(links, key, n=n), Kept(first.sparkSession, on, n)
    try:
        with shuffles(first.sparkSession, n):
            if had is not None:
                known.add(had.select(first.columns).repartition(known.n, *on))
            n = known.add(first.repartition(known.n, *on))
            for _ in range(rounds):
                if not n:
                    return known.all()
                n = known.add(step(dealt.all(), known.new(), known.all()))
                if known.rounds % APART == 0 and n:
                    known.merge()
    finally:
        dealt.close()
        known.close()
    raise RuntimeError(f"no end after {rounds} rounds")


def inner(links: DataFrame, src: str = "callee", dst: str = "caller") -> DataFrame:
    """The links whose end is the start of another. A walk's rounds need no others: what only ends links, as functions that
    nobody calls do, takes what it gets in one step after the last round."""
    return links.join(links.select(F.col(src).alias(dst)).distinct(), dst, "left_semi").select(*links.columns)


def effect_fixpoint(edges: DataFrame, direct: DataFrame, cross: DataFrame | None = None, rounds: int = ROUNDS, core: DataFrame | None = None, passed: Column | None = None) -> DataFrame:
    """fn, mask: the least fixpoint of mask(fn) = direct(fn) | cross(fn) | masks of its callees; direct and cross (what
    functions take over from other reports) have fn, mask. core: `inner` of edges, where it is known already, or more of them,
    with all calls of each of its callers; if it is edges itself, no last step is left. passed: what a call hands to its caller, of its columns and its callee's mask, if
    not all; it must go bit by bit."""
    passed = F.col("mask") if passed is None else passed
    seed = direct.select("fn", "mask") if cross is None else direct.select("fn", "mask").unionByName(cross.select("fn", "mask"))
    united = lambda df: df.groupBy("fn").agg(F.bit_or("mask").alias("mask"))

    def step(links: DataFrame, new: DataFrame, known: DataFrame) -> DataFrame:
        # What is new is the small side: with a table of it, neither links nor what is known need be sorted.
        got = united(links.join(new.withColumnRenamed("fn", "callee").hint("shuffle_hash"), "callee").select(F.col("caller").alias("fn"), passed.alias("mask")))
        return got.hint("shuffle_hash").join(united(known).withColumnRenamed("mask", "had"), "fn", "left").withColumn("mask", F.expr("mask & ~coalesce(had, 0)")).filter("mask <> 0").select("fn", "mask")

    first = united(seed).filter("mask <> 0")
    core = stored(inner(edges)) if core is None else core
    called = core.select("callee").union(core.select("caller")).distinct()
    # What no call of the core names is in no round, but its callers may get it in the last step.
    known = united(grow(core, "callee", first.join(called.withColumnRenamed("callee", "fn"), "fn", "left_semi"), step, ["fn"], rounds).unionByName(first))
    if core is edges:
        return known
    last = edges.join(known.withColumnRenamed("fn", "callee").hint("shuffle_hash"), "callee").select(F.col("caller").alias("fn"), passed.alias("mask")).filter("mask <> 0")
    return united(last.unionByName(known))


def value_fixpoint(edges: DataFrame, direct: DataFrame, rounds: int = ROUNDS, core: DataFrame | None = None) -> DataFrame:
    """fn, value: every value of a function or of anything it reaches; direct has fn, value. Values travel as bits, 64 in a
    row, and become rows at the end."""
    from emberflow.operators.bits import members, numbered, spread

    values = numbered(direct.filter("value is not null").select("value").distinct())
    seeds = direct.select("fn", "value").distinct().join(values, "value").select(F.col("fn").alias("node"), "chunk", "mask")
    held = spread(up(edges), seeds, rounds=rounds, core=None if core is None else up(core))
    return members(held).join(values.select("chunk", "bit", "value"), ["chunk", "bit"]).select(F.col("node").alias("fn"), "value")


def reach(links: DataFrame, seeds: DataFrame, through: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """source, node, hops: breadth-first from seeds (source, node, hops) along links (src, dst), least hops each.

    through, if given, holds the nodes (node) from which the walk goes on; others are reached but not passed.
    """
    def step(links: DataFrame, new: DataFrame, known: DataFrame) -> DataFrame:
        front = new if through is None else new.join(through, "node", "left_semi")
        got = links.join(front.withColumnRenamed("node", "src"), "src").groupBy("source", F.col("dst").alias("node")).agg((F.min("hops") + 1).alias("hops"))
        return got.join(known.select("source", "node"), ["source", "node"], "left_anti")

    return grow(links.select("src", "dst"), "src", seeds.select("source", "node", F.col("hops").cast("int").alias("hops")), step, ["source", "node"], rounds)


def down(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("caller").alias("src"), F.col("callee").alias("dst"))


def up(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("callee").alias("src"), F.col("caller").alias("dst"))


def start(node: Column | str, hops: int = 0) -> list[Column]:
    """Columns of a seed that is its own source."""
    c = F.col(node) if isinstance(node, str) else node
    return [c.alias("source"), c.alias("node"), F.lit(hops).alias("hops")]


def nearest(edges: DataFrame, ends: DataFrame, through: Column | None = None, chains: bool = False, rounds: int = ROUNDS) -> DataFrame:
    """rule, fn, hops, found: for each rule the nearest of its ends (rule, fn) to each function that reaches one, ends
    themselves at 0; with chains, next: the callee that a shortest chain goes on with, null at an end.

    One backward walk for all rules, so the cost follows the graph and not the number of starts or rules. Of equally
    near ends the first that a walk in order of callees' names meets: a function takes what its first callee one step
    nearer has found. through, a condition on the columns of edges and rule, tells which calls a rule's walk may use.
    """
    first = ends.select("rule", "fn").distinct().select("rule", "fn", F.lit(0).alias("hops"), F.col("fn").alias("found"), *([F.lit(None).cast("string").alias("next")] if chains else []))

    def step(links: DataFrame, new: DataFrame, known: DataFrame) -> DataFrame:
        got = links.join(new.withColumnRenamed("fn", "callee"), "callee")
        got = got if through is None else got.filter(through)
        # All of a function's callees that are one step nearer were found in the last round.
        got = got.groupBy("rule", F.col("caller").alias("fn")).agg(F.min(F.struct("callee", "hops", "found")).alias("m"))
        got = got.join(known.select("rule", "fn"), ["rule", "fn"], "left_anti")
        return got.select("rule", "fn", (F.col("m.hops") + 1).alias("hops"), F.col("m.found").alias("found"), *([F.col("m.callee").alias("next")] if chains else []))

    return grow(edges, "callee", first, step, ["rule", "fn"], rounds)


def first_found(edges: DataFrame, near: DataFrame, starts: DataFrame, through: Column | None = None) -> DataFrame:
    """rule, fn, hops, found of starts (rule, fn), one call away at least: a start isn't its own end unless it is reached
    again."""
    step = edges.join(starts.select("rule", F.col("fn").alias("caller")), "caller").join(near.select("rule", F.col("fn").alias("callee"), "hops", "found"), ["rule", "callee"])
    step = step if through is None else step.filter(through)
    return step.groupBy("rule", F.col("caller").alias("fn")).agg(F.min(F.struct("hops", "callee", "found")).alias("m")).select("rule", "fn", (F.col("m.hops") + 1).alias("hops"), F.col("m.found").alias("found"))


def shortest_paths(edges: DataFrame, starts: DataFrame, carriers: DataFrame, ends: DataFrame) -> DataFrame:
    """start, step, fn: a shortest chain from each start (fn) to the nearest of ends (fn) through carriers (fn).

    Of equally short chains the one that comes first by its names, step for step; a start among the ends is its own
    chain of one; a start that reaches no end has no rows.
    """
    inside = edges.join(carriers.withColumnRenamed("fn", "callee"), "callee", "left_semi")
    near = stored(nearest(inside, ends.select(F.lit("").alias("rule"), "fn"), chains=True).select("fn", "next"))
    first = near.join(starts.select("fn").distinct(), "fn").select(F.col("fn").alias("start"), F.lit(0).alias("step"), "fn")
    # Only starts' chains are unrolled, a step a round; a chain has no step twice, so nothing need be looked up.
    go_on = lambda links, new, known: links.join(new, "fn").select("start", (F.col("step") + 1).alias("step"), F.col("next").alias("fn"))
    return grow(near.filter("next is not null"), "fn", first, go_on, ["start", "step"])
