"""Mixing sources to target weights with a low-discrepancy source schedule.

Slot i has the golden-ratio point frac((i + 0.5) * phi). Mapped through the sources' cumulative shares it names the
slot's source; slots are ranked within their source, and rank r takes block r mod (number of blocks) of the
source's documents in md5 order, cut to blocks of equal tokens. Blocks are of at most 256 words, or more where the mix
would have more than SLOTS of them, so a slot's number keeps its point exact.

Cases: a null or empty text has size 0, takes nothing and stays in the result; null sources form one source, last
in order; without any words all targets are 0; an empty table gives no rows; repeated rows count each; ties in the
md5 order go by doc_id and size. No document is taken more than `most` times.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberflow.llm import arrays
from emberflow.llm.common import free_name, key_text, ready, running, small, stored, text_of

GOLDEN = (math.sqrt(5) - 1) / 2
#: Cells of [0, 1) by which points meet the sources' intervals, at least, and about how many slots there are at most.
CELLS, SLOTS = 4096, 50_000_000


def _in_order() -> list:
    """Sources by code point, null last."""
    return [F.col("source").isNull(), F.col("source")]


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size in words of every document."""

    def count(batches):
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["source"].cast(pa.string()), pa.array(arrays.count_words(b["text"]), pa.int64())], ["doc_id", "source", "size"])

    ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).mapInArrow(count, f"doc_id {kind}, source string, size long")


def targets(per_source: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """source, source_size, target. Weights repeat over the sources by code point, null last; a target stops at
    `most` times its source's size and what is over is shared again by weight.

    Filling stops at a level L (words per unit of weight): target = min(most * size, weight * L). L rises from the
    even share until the targets add up to all sizes; each step is a sum over the sources, of which there may be many.
    """
    rows = running(per_source.select("source", "source_size"), _in_order(), {"_rank": F.lit(1)})
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    rows = stored(rows.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(most)))
    total, level, said = float(rows.agg(F.sum("source_size")).first()[0] or 0), -1.0, 0.0
    while said > level:
        level = said
        full = F.col("_cap") <= F.col("_w") * level
        taken, w = rows.agg(F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_w")))).first()
        said = (total - (taken or 0.0)) / w if w else math.inf
    return rows.select("source", "source_size", F.least("_cap", F.when(F.col("_cap") > 0, F.col("_w") * F.lit(level)).otherwise(0.0)).alias("target"))


def plan(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> dict[str, DataFrame]:
    """What the mix is made of: `sources`, `slots` (slot, source, rank, block) and `pieces` (a document's words in
    each block of its source). sized: doc_id, source, size, read more than once."""
    spark = sized.sparkSession
    per_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    total, n_rows = sized.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    block = max(1, min(256, total // 4096), total // SLOTS)
    src = per_source.withColumn("_blocks", F.greatest(F.ceil(F.col("source_size") / block), F.lit(1)).cast("long"))
    src = src.withColumn("_want", F.when(F.col("source_size") > 0, F.col("target") * F.col("_blocks") / F.col("source_size")).otherwise(0.0))
    # Wanted slots in units of 2^-20: sums of whole numbers are the same in any order.
    src = stored(src.withColumn("_units", F.round(F.col("_want") * 2**20).cast("long")))
    n_slots, units, n_sources = src.agg(F.sum("_want"), F.sum("_units"), F.count("*")).first()
    n_slots, units = int(round(n_slots or 0)), max(1, units or 0)
    shares = running(src.select("source", "_blocks", "_units"), _in_order(), {"_from": F.col("_units")})
    # Each interval begins exactly where the one before ends, and the last ends at 1: no point is left out.
    shares = shares.filter("_units > 0").withColumn("_lo", F.col("_from") / F.lit(float(units))).withColumn("_hi", (F.col("_from") + F.col("_units")) / F.lit(float(units)))
    n_cells = max(CELLS, 1 << n_sources.bit_length())
    cells = shares.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") * n_cells), F.least(F.floor(F.col("_hi") * n_cells), F.lit(n_cells - 1)))))
    points = spark.range(n_slots).select(F.col("id").alias("slot"), (((F.col("id") + 0.5) * GOLDEN) % 1.0).alias("_u")).withColumn("_cell", F.floor(F.col("_u") * n_cells))
    named = points.join(cells, "_cell").filter("_u >= _lo and _u < _hi").select("slot", "source", "_blocks")
    slots = stored(_ranked(named, n_slots).select("slot", "source", "rank", F.expr("rank % _blocks").alias("block")).filter(F.col("rank") < most * F.expr("greatest(_blocks, 0)")))
    placed = _placed(sized, n_rows)
    joined = placed.join(src.select(F.col("source").alias("_s"), "source_size", "target", "_blocks"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # Block b holds the words from floor(b * source_size / blocks) on; word p is in block ((p + 1) * blocks - 1) div size.
    first, last = F.expr("((_from + 1) * _blocks - 1) div source_size"), F.expr("((_from + size) * _blocks - 1) div source_size")
    cut = joined.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    cut = cut.select("doc_id", "_key", "source", "block", (F.least(F.expr("_from + size"), F.expr("((block + 1) * source_size) div _blocks")) - F.greatest(F.col("_from"), F.expr("(block * source_size) div _blocks"))).alias("words"))
    return {"sources": src.select("source", "source_size", "target"), "slots": slots, "pieces": cut, "documents": joined}


def _ranked(named: DataFrame, n_slots: int) -> DataFrame:
    """Rank of each slot within its source, from 0, by counts of runs of slots: no task holds a whole source."""
    run = max(1024, int(math.sqrt(max(1, n_slots))))
    named = named.withColumn("_run", F.floor(F.col("slot") / run))
    counts = named.groupBy("source", "_run").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("source").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("source").alias("_s"), F.col("_run").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("source", "_run").orderBy("slot")
    ranked = named.withColumn("_own", F.row_number().over(own) - 1)
    return ranked.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_run") == F.col("_r"))).select("slot", "source", "_blocks", (F.col("_before") + F.col("_own")).alias("rank"))


def _placed(sized: DataFrame, n_rows: int) -> DataFrame:
    """Where each document's words begin among its source's, in md5 order; sums by (source, md5 prefix) come first."""
    digits = 1
    while 16**digits * 2000 < n_rows:
        digits += 1
    rows = sized.withColumn("_h", F.md5(key_text())).withColumn("_part", F.substring("_h", 1, digits))
    sums = rows.groupBy("source", "_part").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("source", "_part").orderBy("_h", "doc_id", "size")
    # Repeated rows are told apart by their number, so each takes its own share.
    rows = rows.withColumn("_own", F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_nth", F.row_number().over(own))
    rows = rows.withColumn("_key", F.concat_ws(":", F.col("_h"), F.col("_nth").cast("string")))
    return rows.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p"))).select("doc_id", "_key", "source", "size", (F.col("_before") + F.col("_own")).alias("_from"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, size, source, source_size, target and taken: words of the document that the schedule takes."""
    made = plan(stored(sizes(docs)), weights, most)
    times = made["slots"].groupBy("source", "block").agg(F.count("*").alias("_times")).select(F.col("source").alias("_s"), F.col("block").alias("_b"), "_times")
    taken = made["pieces"].join(times, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))).groupBy("source", "_key").agg(F.sum(F.col("words") * F.col("_times")).alias("_taken")).select(F.col("source").alias("_s"), F.col("_key").alias("_k"), "_taken")
    docs_ = made["documents"]
    return docs_.join(taken, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_key") == F.col("_k")), "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The documents as the mix holds them, each as often as its words were taken; columns are those of docs.

    A share of a document is rounded up with that share as chance, drawn from its id and text, so small documents don't
    vanish together and the words of each source come near its target; reruns agree. Rows with the same doc_id and
    source share one rate. A document without words stays once.
    """
    i, s, r, u, c = (free_name(docs.columns, n) for n in ("_mix_id", "_mix_source", "_mix_rate", "_mix_draw", "_mix_copy"))
    m = mix(docs, weights, most).groupBy(F.col("doc_id").alias(i), F.col("source").alias(s)).agg(F.sum("taken").alias("t"), F.sum("size").alias("n"))
    m = m.select(i, s, F.when(F.col("n") == 0, 1.0).otherwise(F.col("t") / F.col("n")).alias(r)).filter(F.col(r) > 0)
    joined = docs.join(m.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(m[i]) & docs["source"].cast("string").eqNullSafe(m[s]))
    joined = joined.withColumn(u, F.pmod(F.xxhash64(key_text(), text_of()), F.lit(2**31)) / float(2**31))
    times = (F.floor(r) + (F.col(u) < F.col(r) - F.floor(r)).cast("int")).cast("int")
    return joined.withColumn(c, F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))).select(*[docs[x] for x in docs.columns])
