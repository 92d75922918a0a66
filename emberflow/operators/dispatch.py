"""Which bodies a virtual call may run: of the owner and its subtypes, else the one that it inherits in the JVM's order.

Frames: sites (site, owner, method); supers (type, super, and where known kind: class or interface, place: position in
the list of supertypes); methods (owner, method); hierarchy (type, closed, unseen), as rows.closed_types tells: a closed
type has all its subtypes in sight, one with unseen subtypes certainly has others, and of any other type nobody knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberflow.operators.fixpoint import ROUNDS, grow
from emberflow.plans.runtime import Kept, bucketed, buckets, counted, shuffles, stored

# Fixed value: the type that ends every chain of superclasses and isn't looked into.
ROOT = ("java.lang.Object", "java/lang/Object")
ASKED = ["owner", "method"]


def _links(supers: DataFrame) -> DataFrame:
    """type, super, kind, place: kind is null where it isn't known, place follows the names where it isn't told."""
    rows = supers.filter(~F.col("super").isin(*ROOT))
    kind = F.col("kind") if "kind" in supers.columns else F.lit(None).cast("string")
    rows = rows.select("type", "super", kind.alias("kind"), *(["place"] if "place" in supers.columns else []))
    return rows if "place" in rows.columns else rows.withColumn("place", F.row_number().over(Window.partitionBy("type").orderBy("super")))


def bodies_below(asked: DataFrame, supers: DataFrame, methods: DataFrame, hierarchy: DataFrame | None = None, most: int = 12, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """owner, method, node of the bodies among self-or-subtypes of each asked (owner, method), and those asked (owner,
    method) that have more than `most`.

    An asked type that isn't closed is dropped from the walk as soon as more than `most` bodies are found, so what is
    walked beyond the bound is a round at most; a closed one is walked to its end, as all its bodies count.
    """
    spark = asked.sparkSession
    links, n_links = counted(supers.select(F.col("super").alias("node"), F.col("type").alias("below")).distinct())
    first, n_first = counted(asked.select(*ASKED, F.col("owner").alias("node")).distinct())
    width = buckets(spark, n_links + n_first)
    down = bucketed(links, "node", n=width)
    seen, hits = Kept(spark, [*ASKED, "node"], width), Kept(spark, ASKED, width)
    has = stored(methods.select(F.col("owner").alias("node"), "method").distinct())
    closed = None if hierarchy is None else hierarchy.filter("closed").select(F.col("type").alias("owner"), F.lit(True).alias("_closed")).distinct()

    def wide() -> DataFrame:
        n = hits.all().groupBy(*ASKED).agg(F.count("*").alias("n")).filter(F.col("n") > most)
        return n if closed is None else n.join(closed, "owner", "left").filter("_closed is null")

    # A task writes a file for each bucket that it has rows of, so rows are dealt before.
    found = lambda: seen.new().join(has, ["node", "method"]).select(*ASKED, "node").repartition(width, *ASKED)
    try:
        with shuffles(spark, width):
            n = seen.add(first.repartition(width, *ASKED, "node"))
            hits.add(found())
            for _ in range(rounds):
                if not n:
                    over = stored(wide().select(*ASKED))
                    return hits.all().join(over, ASKED, "left_anti"), over
                front = seen.new().join(wide(), ASKED, "left_anti")
                got = down.all().join(front, "node").select(*ASKED, F.col("below").alias("node")).distinct()
                n = seen.add(got.join(seen.all(), [*ASKED, "node"], "left_anti"))
                hits.add(found())
                if seen.rounds % 8 == 0:
                    seen.merge()
                    hits.merge()
    finally:
        for t in (down, seen, hits):
            t.close()
    raise RuntimeError(f"no end after {rounds} rounds")


def _first(rows: DataFrame, way: Column) -> DataFrame:
    """Of the ways that lead to a type in one round the one that comes first."""
    return rows.groupBy(*ASKED, "node").agg(F.min(way).alias("way"))


def inherited(asked: DataFrame, supers: DataFrame, methods: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """owner, method, node: the first supertype of each asked (owner, method) that has a body, in the JVM's order.

    First the superclasses, nearest first, to the end of the chain; only then the interfaces, those of the type before
    those of its superclasses, each list in its order and a list of supertypes after all that were met before it. What is
    above an interface is an interface. A list of unknown kinds is walked with the phase that has met it.
    """
    links = stored(_links(supers))
    has = stored(methods.select(F.col("owner").alias("node"), "method").distinct())
    path = lambda: F.concat("way", F.array(F.col("place").cast("int")))

    def climb(links: DataFrame, new: DataFrame, known: DataFrame) -> DataFrame:
        # A way is as long as the round, so ways of one round are in order of their places.
        front = new.join(has, ["node", "method"], "left_anti")
        got = links.join(front.withColumnRenamed("node", "type"), "type").select(*ASKED, F.col("super").alias("node"), path().alias("way"))
        return _first(got, F.col("way")).join(known.select(*ASKED, "node"), [*ASKED, "node"], "left_anti")

    starts = asked.select(*ASKED, F.col("owner").alias("node"), F.array().cast("array<int>").alias("way")).distinct()
    on = [*ASKED, "node"]
    order = F.struct(F.size("way").alias("n"), F.col("way"))
    classes = stored(grow(links.filter("kind is null or kind = 'class'"), "type", starts, climb, on, rounds))
    best = lambda rows: rows.join(has, ["node", "method"]).groupBy(*ASKED).agg(F.min(F.struct(F.size("way").alias("n"), F.col("way"), F.col("node"))).alias("m")).select(*ASKED, F.col("m.node").alias("node"))
    found = stored(best(classes))
    rest = classes.join(found, ASKED, "left_anti")
    # The queue of interfaces as the class phase leaves it: by the class that lists them, then by place.
    rank = F.row_number().over(Window.partitionBy(*ASKED).orderBy(order))
    queue = rest.withColumn("way", F.array(rank)).join(links.filter("kind = 'interface'").withColumnRenamed("type", "node"), "node")
    queue = _first(queue.select(*ASKED, F.col("super").alias("node"), path().alias("way")), F.col("way")).join(rest.select(*on), on, "left_anti")
    return found.unionByName(best(grow(links, "type", queue, climb, on, rounds, rest.select(*on, F.lit(None).cast("array<int>").alias("way"))).filter("way is not null")))


def dispatch(sites: DataFrame, supers: DataFrame, methods: DataFrame, hierarchy: DataFrame | None = None, most: int = 12) -> DataFrame:
    """site, target, how, complete: the bodies that each call may run.

    how: below (of the owner or a subtype), inherited, wide (more than `most` and not closed, no target told), none.
    complete: false where a target may be missing for sure: wide calls, and owners with subtypes that aren't in sight.
    """
    asked = stored(sites.select(*ASKED).distinct())
    below, over = bodies_below(asked, supers, methods, hierarchy, most)
    below = stored(below)
    rest = asked.join(below.select(*ASKED).distinct(), ASKED, "left_anti").join(over, ASKED, "left_anti")
    rows = below.withColumn("how", F.lit("below")).unionByName(inherited(rest, supers, methods).withColumn("how", F.lit("inherited"))).unionByName(over.select(*ASKED, F.lit(None).cast("string").alias("node"), F.lit("wide").alias("how")))
    out = sites.join(rows, ASKED, "left").withColumn("how", F.coalesce("how", F.lit("none")))
    gap = F.lit(False)
    if hierarchy is not None:
        out = out.join(hierarchy.filter("unseen").select(F.col("type").alias("owner"), F.lit(True).alias("_gap")).distinct(), "owner", "left")
        gap = F.col("_gap").isNotNull()
    target = F.when(F.col("node").isNotNull(), F.concat_ws(".", "node", "method"))
    return out.select("site", target.alias("target"), "how", (~gap & (F.col("how") != "wide")).alias("complete"))
