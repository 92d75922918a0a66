"""What a closed fixpoint must say afterwards: where a call may run a body that carries more than its caller reports, the
caller is Unknown, and that goes to its own callers, which may make other calls such a case.

The outer loop decides calls and closes again until no call is added. Unknown is all that it ever adds, so effects are
decided once; later turns look at calls whose body has become Unknown in the turn before, and at nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberflow.functions.effects import BIT
from emberflow.operators.fixpoint import ROUNDS, grow, inner
from emberflow.plans.runtime import counted, stored

UNKNOWN = BIT["Unknown"]


def disclose(edges: DataFrame, inferred: DataFrame, sites: DataFrame, rounds: int = ROUNDS, core: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """fn, mask after all that had to be said; and caller, why, turn of every call for which it was.

    inferred: fn, mask, the least fixpoint over edges (caller, callee); sites: caller, via, body of calls that aren't edges
    as they can't be resolved. A call is a case if its body has an effect that its caller hasn't, Unknown included, when
    the turn begins; why is dispatch:<via>. A body that isn't in inferred has no effects.
    core: `inner` of edges, where it is known already.
    """
    core = stored(inner(edges.select("caller", "callee"))) if core is None else core.select("caller", "callee")
    sites = stored(sites.select("caller", "via", "body").distinct())
    mask_of = lambda key, name: inferred.select(F.col("fn").alias(key), F.col("mask").alias(name))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = sites.join(mask_of("body", "does"), "body").join(mask_of("caller", "says"), "caller", "left")
    due = both.filter(zero("does").bitwiseAND(F.bitwise_not(zero("says"))) != 0).select("caller", "via")

    def climb(links: DataFrame, new: DataFrame, known: DataFrame) -> DataFrame:
        got = links.join(new.withColumnRenamed("fn", "callee"), "callee").select(F.col("caller").alias("fn")).distinct()
        return got.join(known.select("fn"), "fn", "left_anti")

    unknown = stored(inferred.filter(F.col("mask").bitwiseAND(UNKNOWN) != 0).select("fn"))
    told, added = [], []
    for turn in range(1, rounds + 1):
        said, n = counted(due.distinct().withColumn("turn", F.lit(turn)))
        if not n:
            break
        told.append(said)
        seeds = said.select(F.col("caller").alias("fn")).distinct().join(unknown, "fn", "left_anti")
        new = stored(grow(core, "callee", seeds, climb, ["fn"], rounds, unknown).join(unknown, "fn", "left_anti"))
        # Rounds are over what is called; the others take it from their callees in one step.
        tops = climb(edges, new, unknown.unionByName(new))
        new = stored(new.unionByName(tops))
        added.append(new)
        # A call of the turns to come: its body is Unknown since this one, its caller still isn't.
        unknown = stored(unknown.unionByName(new))
        due = sites.join(new.select(F.col("fn").alias("body")), "body").join(unknown.select(F.col("fn").alias("caller")), "caller", "left_anti").select("caller", "via")
    else:
        raise RuntimeError(f"no end after {rounds} turns")
    spark = edges.sparkSession
    cases, names = spark.createDataFrame([], "caller string, via string, turn int"), spark.createDataFrame([], "fn string")
    for t, a in zip(told, added):
        cases, names = cases.unionByName(t), names.unionByName(a)
    rows = inferred.select("fn", "mask").unionByName(names.select("fn", F.lit(UNKNOWN).alias("mask"))).groupBy("fn").agg(F.bit_or("mask").alias("mask"))
    return rows, cases.select("caller", F.concat(F.lit("dispatch:"), "via").alias("why"), "turn")
