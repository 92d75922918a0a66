"""Hierarchical weighted hash tree: rows descend region, rack and shard by weighted hash draws.

Law `key`: doc_id and the tree alone decide. At a node, child c with weight w draws -ln(u)/w, where u in (0,1)
comes from md5(key, path of c); the smallest draw wins. Draws of other children don't change when one child's
weight grows, so rows move only into the subtree that grew. `grown()` adds a shard as a region of its own, so one
more shard takes rows only into itself.

Cases: a null doc_id counts as the key 'null'; a null text has 0 bytes; an empty table gives no rows; rows with
the same key share a shard; other columns pass through only where asked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberflow.llm.common import free_name, key_text, ready, stored, text_of


@dataclass(frozen=True)
class Tree:
    """Weights of shards: regions hold racks, racks hold shards; shards are numbered in this order."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @staticmethod
    def even(n_regions: int = 2, n_racks: int = 3, n_shards: int = 4) -> Tree:
        return Tree((((1.0,) * n_shards,) * n_racks,) * n_regions)

    def grown(self, weight: float = 1.0) -> Tree:
        return Tree((*self.regions, ((weight,),)))


def _draws(key: Column, path: list[Column], weights: Column) -> Column:
    """Struct (draw, index) of each child below the node at path."""

    def draw(weight: Column, i: Column) -> Column:
        named = F.concat_ws(".", *[p.cast("string") for p in path], i.cast("string"))
        bits = F.conv(F.substring(F.md5(F.concat_ws("|", key, named)), 1, 13), 16, 10).cast("double")
        return F.struct((-F.log((bits + 0.5) / float(2**52)) / weight).alias("d"), i.alias("i"))

    return F.transform(weights, draw)


def _nested(values: list) -> Column:
    return F.array(*[_nested(v) if isinstance(v, list) else F.lit(v) for v in values])


def with_shard(rows: DataFrame, key: str, tree: Tree, name: str, grown: str | None = None, weight: float = 1.0) -> DataFrame:
    """rows with the shard of their key, an int from 0; one column a level keeps the generated code small.

    grown, if given, names a column with the shard under tree.grown(weight): the new region draws against the regions
    there were, whose draws stay as they are, so a row moves into it or nowhere.
    """
    regions = [[list(map(float, rack)) for rack in racks] for racks in tree.regions]
    number = iter(range(10**9))
    first = [[[next(number) for _ in rack][0] for rack in racks] for racks in regions]
    n_shards = sum(len(rack) for racks in regions for rack in racks)
    d, g, r, k, s = (free_name(rows.columns, f"_{name}_{x}") for x in "dgrks")
    at = lambda table, *ix: table if not ix else at(F.element_at(table, F.col(ix[0]) + 1), *ix[1:])
    tops = [sum(map(sum, racks)) for racks in regions]
    rows = rows.withColumn(d, _draws(F.col(key), [], _nested(tops + ([float(weight)] if grown else []))))
    best = F.array_min(F.slice(d, 1, len(tops)))
    rows = rows.withColumn(g, F.element_at(d, -1)["d"] < best["d"]).withColumn(r, best["i"]).drop(d)
    rows = rows.withColumn(k, F.array_min(_draws(F.col(key), [F.col(r)], at(_nested([[sum(rack) for rack in racks] for racks in regions]), r)))["i"])
    rows = rows.withColumn(s, F.array_min(_draws(F.col(key), [F.col(r), F.col(k)], at(_nested(regions), r, k)))["i"])
    rows = rows.withColumn(name, (at(_nested(first), r, k) + F.col(s)).cast("int"))
    if grown:
        rows = rows.withColumn(grown, F.when(F.col(g), n_shards).otherwise(F.col(name)).cast("int"))
    return rows.drop(g, r, k, s)


def assign_shards(docs: DataFrame, tree: Tree, n_rows: int) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard.

    slot numbers a shard's rows from 0 in order of md5(doc_id). It is made of counts by (shard, prefix of the md5)
    plus a number within that prefix, so no task holds a whole shard.
    """
    ready(docs.sparkSession)
    digits = 1
    while 16**digits * 2000 < n_rows:
        digits += 1
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text_of()) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text_of(), "UTF-8")).cast("long").alias("text_crc32"),
        key_text().alias("_key"),
        F.md5(key_text()).alias("_h"),
    ).withColumn("_part", F.substring("_h", 1, digits))
    # Drawn once and written: both the counts and the numbers below read it.
    rows = stored(with_shard(rows, "_key", tree, "shard", "grown_shard").drop("_key"))
    counts = rows.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    # At most shards x 16^digits rows, spread over the shards; a shard's are about n_rows / 2000.
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    own = Window.partitionBy("shard", "_part").orderBy("_h", "text_crc32", "size")
    numbered = rows.withColumn("_own", F.row_number().over(own) - 1)
    return numbered.join(starts, ["shard", "_part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_from") + F.col("_own")).cast("long").alias("slot"), "grown_shard"
    )
