"""The trace check as a stream: new observations against a computed report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberflow.functions.effects import BIT, bit_of, mask_of


def violations(observed: DataFrame, functions: DataFrame, effects: tuple[str, ...] = ("Exec", "Fs", "Net"), late: str = "10 minutes") -> DataFrame:
    """fn, effect, ts of a stream (fn, effect, ts) that the report (fn, mask) neither infers nor discloses.

    Repeats of a function's effect within the watermark are told once, so state stays bounded; a function that the
    report lacks claims to be pure. functions is static and joined by its name.
    """
    seen = observed.filter(F.col("effect").isin(*effects)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["fn", "effect"])
    rows = seen.join(functions.select("fn", "mask"), "fn", "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    net = F.col("mask").bitwiseAND(BIT["Net"]) != 0  # Net covers Llm and Db, as in the batch check
    rows = rows.withColumn("mask", F.when(net, F.col("mask").bitwiseOR(mask_of(("Llm", "Db")))).otherwise(F.col("mask")))
    unknown = bit_of(F.lit("Unknown"))
    return rows.filter((F.col("mask").bitwiseAND(bit_of(F.col("effect"))) == 0) & (F.col("mask").bitwiseAND(unknown) == 0)).select("fn", "effect", "ts")


def counts(observed: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window, effect, n: observations by time window and effect, late ones up to the watermark."""
    return observed.withWatermark("ts", late).groupBy(F.window("ts", window), "effect").agg(F.count("*").alias("n"))
