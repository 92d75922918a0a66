"""Sets of functions, kept as bits: 64 members of a set in a row, so a closure over sets makes no row for each pair.

A set over members numbered from 0 is rows (node, chunk, mask): bit b of chunk c tells whether member 64 * c + b is in the
set of node. Sets are united by bit_or, and what is new is found by & ~, as effects are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberflow.operators.fixpoint import ROUNDS, grow, inner
from emberflow.plans.runtime import counted, stored

WIDTH = 64


def numbered(rows: DataFrame) -> DataFrame:
    """rows with chunk, bit and mask of their own; numbers are dense in each partition, so few chunks are part-empty."""
    rows = stored(rows.withColumn("_id", F.monotonically_increasing_id()))
    bit = (F.col("_id") % WIDTH).cast("int")
    return rows.select("*", F.expr(f"_id div {WIDTH}").alias("chunk"), bit.alias("bit"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("mask")).drop("_id")


def united(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "chunk").agg(F.bit_or("mask").alias("mask"))


def spread(links: DataFrame, seeds: DataFrame, through: DataFrame | None = None, rounds: int = ROUNDS, core: DataFrame | None = None) -> DataFrame:
    """node, chunk, mask: what reaches each node from seeds (node, chunk, mask) along links (src, dst), seeds included.
    through, if given, holds the nodes (node) from which it goes on. core: `inner` of links, where it is known already."""

    def step(links: DataFrame, new: DataFrame, known: DataFrame) -> DataFrame:
        front = new if through is None else new.join(through, "node", "left_semi")
        got = united(links.join(front.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "chunk", "mask"), "node")
        had = united(known, "node").withColumnRenamed("mask", "had")
        return got.join(had, ["node", "chunk"], "left").withColumn("mask", F.expr("mask & ~coalesce(had, 0)")).filter("mask <> 0").select("node", "chunk", "mask")

    seeds = stored(united(seeds, "node"))
    core = stored(inner(links.select("src", "dst"), "src", "dst")) if core is None else core.select("src", "dst")
    named = core.select(F.col("src").alias("node")).union(core.select("dst")).distinct()
    # As in effect_fixpoint: what ends links only is in no round, and takes what it gets in one step.
    known = stored(united(grow(core, "src", seeds.join(named, "node", "left_semi"), step, ["node", "chunk"], rounds).unionByName(seeds), "node"))
    # Written, so that Spark knows its size: a small one meets all links without moving them.
    front = known if through is None else stored(known.join(through, "node", "left_semi"))
    last = links.join(front.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "chunk", "mask")
    return united(last.unionByName(known), "node")


def weighed(rows: DataFrame, weight: Column) -> DataFrame:
    """chunk, bit, n: for each member the sum of weight over the rows (chunk, mask) whose set holds it; members of no set
    are left out. One row a chunk is shuffled from each task."""
    sums = [F.sum(F.when(F.call_function("getbit", "mask", F.lit(b)) == 1, weight)).alias(f"b{b}") for b in range(WIDTH)]
    each = rows.groupBy("chunk").agg(*sums)
    return each.select("chunk", F.posexplode(F.array(*[F.col(f"b{b}") for b in range(WIDTH)])).alias("bit", "n")).filter("n is not null")


def members(rows: DataFrame) -> DataFrame:
    """rows with bit in place of mask, one row for each member of a set: for answers that list them."""
    held = F.filter(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda b: F.call_function("getbit", "mask", b) == 1)
    return rows.withColumn("bit", F.explode(held)).drop("mask")


def trimmed(links: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, int]:
    """Calls left when functions without callers or without callees are taken away until none is; all cycles are left."""
    rows, n = counted(links)
    for _ in range(rounds):
        called = rows.select(F.col("callee").alias("caller")).distinct()
        calling = rows.select(F.col("caller").alias("callee")).distinct()
        left, m = counted(rows.join(called, "caller", "left_semi").join(calling, "callee", "left_semi").select("caller", "callee"))
        if m == n:
            return rows, n
        rows, n = left, m
    raise RuntimeError(f"no end after {rounds} rounds")


def components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """fn, comp: strongly connected components, by the name of a member; a function that is in no cycle may be left out,
    and is its own component.

    Trim; colour every function by the least name among those that reach it and by the least among those it reaches,
    itself included, both in one walk. Where the two are one, that is the component, as its members are reached from
    it and reach it. Members of one component have both colours alike, so calls between others are cut, and the rest is
    done again; the component of the least name goes in each turn, and with it at least one of every part that was cut.
    """
    left, n = trimmed(inner(edges.select("caller", "callee").filter("caller <> callee")).distinct(), rounds)
    found = []

    def paint(links: DataFrame, new: DataFrame, known: DataFrame) -> DataFrame:
        got = links.join(new.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("colour"))
        had = known.groupBy("node").agg(F.min("colour").alias("had"))
        return got.join(had, "node").filter("colour < had").select("node", "colour")

    ways = {">": ("caller", "callee"), "<": ("callee", "caller")}
    for _ in range(rounds):
        if not n:
            break
        side = lambda way, c: F.concat(F.lit(way), F.col(c))
        fore, back = (left.select(side(w, a).alias("src"), side(w, b).alias("dst")) for w, (a, b) in ways.items())
        names = left.select(F.col("caller").alias("fn")).union(left.select("callee")).distinct()
        firsts = names.select(F.explode(F.array(*[F.struct(side(w, "fn").alias("node"), F.col("fn").alias("colour")) for w in ways])).alias("x")).select("x.*")
        painted = grow(fore.unionByName(back), "src", firsts, paint, ["node"], rounds).groupBy("node").agg(F.min("colour").alias("colour"))
        way = F.substring("node", 1, 1)
        both = painted.groupBy(F.substring("node", 2, 1 << 30).alias("fn")).agg(*[F.min(F.when(way == w, F.col("colour"))).alias(c) for w, c in ((">", "above"), ("<", "below"))])
        colours = stored(both)
        found.append(colours.filter("above = below").select("fn", F.col("above").alias("comp")))
        # Nothing of a found component has calls left: its functions share their colours with no other.
        of = lambda c: colours.filter("above <> below").select(F.col("fn").alias(c), F.struct("above", "below").alias(f"{c}_colours"))
        within = left.join(of("caller"), "caller").join(of("callee"), "callee").filter("caller_colours = callee_colours").select("caller", "callee")
        left, n = trimmed(within, rounds)
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    out = edges.sparkSession.createDataFrame([], "fn string, comp string")
    for f in found:
        out = out.unionByName(f)
    return out


def condensed(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """Calls between components, without those inside one."""
    of = lambda c: comps.select(F.col("fn").alias(c), F.col("comp").alias(f"{c}_comp"))
    rows = edges.join(of("caller"), "caller", "left").join(of("callee"), "callee", "left")
    return rows.select(F.coalesce("caller_comp", "caller").alias("caller"), F.coalesce("callee_comp", "callee").alias("callee")).filter("caller <> callee").distinct()


def comp_of(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """rows (fn, ...) with comp."""
    return rows.join(comps, "fn", "left").withColumn("comp", F.coalesce("comp", "fn"))
