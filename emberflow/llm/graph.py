"""Connected components of links between ids, as Spark joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberflow.llm.common import stored


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """v, root: every id of links (u, v: long) that isn't the smallest of its component, with that smallest.

    Large-star and small-star steps in turns, each a minimum by node joined to the links, until nothing changes; each
    round is written to the shared folder. Null ids and loops are left out; repeated links count once. An error is
    raised if `rounds` don't suffice.
    """
    e = stored(links.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    said = None
    for _ in range(rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == said or not now[0]:
            return e.select(F.col("u").alias("v"), F.col("v").alias("root"))
        said = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        e = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(least, "u")
        e = stored(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the smallest id that links (u, v) join them to; ids that are the smallest are left out."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(more := new[new], new):
            new = more
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]
