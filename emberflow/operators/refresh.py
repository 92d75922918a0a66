"""A fixpoint of effects kept up to date: what a change of units takes away and adds is walked, and nothing else.

Deletion and rederivation over bits: bits that a lost call or effect may have brought are taken away upwards, through
cycles too; a bit that a function performs itself stays; what is still called by other ways is put back and spread with
what is new. The fixpoint and the calls lie in folders by a hash of the function they are joined on. A walk opens the
folders of the functions that it comes to only, each once: its rows then lie in buckets, and a round moves what is new.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import ExitStack
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from emberflow.operators.fixpoint import ROUNDS
from emberflow.plans.runtime import Kept, buckets, shared_dir, shuffles, stored


def part_of(name: str, n: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(n)).cast("int")


@dataclass
class Folders:
    """Rows in one folder for each value of a hash of `on`; `rows` has the column part."""

    rows: DataFrame
    on: str
    n: int

    @staticmethod
    def write(rows: DataFrame, on: str, n: int = 64) -> Folders:
        path = shared_dir(rows.sparkSession)
        rows.withColumn("part", part_of(on, n)).repartition("part").write.partitionBy("part").parquet(path)
        schema = StructType([*rows.schema.fields, StructField("part", IntegerType())])
        return Folders(rows.sparkSession.read.schema(schema).parquet(path), on, n)

    def parts(self, keys: DataFrame) -> list[int]:
        """The folders that rows with these keys (fn) lie in: n numbers at most."""
        return sorted(r["p"] for r in keys.select(part_of("fn", self.n).alias("p")).distinct().collect())

    def of(self, parts: Iterable[int]) -> DataFrame:
        return self.rows.filter(F.col("part").isin(sorted(parts))).drop("part")

    def near(self, keys: DataFrame) -> DataFrame:
        """The rows of the folders that rows with these keys (fn) lie in."""
        return self.of(self.parts(keys))


class Opened:
    """Rows of the folders that were asked for. Each is read once, and then its rows lie in n buckets by the folders' key;
    less: fn, mask of bits that they haven't got any more."""

    def __init__(self, folders: Folders, n: int, less: DataFrame | None = None):
        self.folders, self.less, self.parts = folders, less, set()
        self.kept = Kept(folders.rows.sparkSession, [folders.on], n)

    def open(self, parts: Iterable[int]) -> None:
        more = set(parts) - self.parts
        if more or not self.parts and not self.kept.name:
            rows = self.folders.of(more)
            self.kept.add((rows if self.less is None else _less(rows, self.less)).repartition(self.kept.n, self.folders.on))
            self.parts |= more

    @property
    def whole(self) -> bool:
        return len(self.parts) == self.folders.n

    def all(self) -> DataFrame:
        return self.kept.all()

    def __enter__(self) -> Opened:
        return self

    def __exit__(self, *_: object) -> None:
        self.kept.close()


def _noted(rows: DataFrame, put: Callable[[DataFrame], Any], *near: Opened, key: str = "fn") -> Any:
    """put(rows), which writes them; the folders that their keys lie in, which the same job notes as bits, are then opened."""
    seen = Observation()
    words = [(i, k, part_of(key, x.folders.n)) for i, x in enumerate(near) for k in range(-(-x.folders.n // 64))]
    bit = lambda k, part: F.when(F.floor(part / 64) == k, F.call_function("shiftleft", F.lit(1).cast("long"), part % 64))
    out = put(rows.observe(seen, *[F.bit_or(bit(k, part)).alias(f"w{i}_{k}") for i, k, part in words]))
    for i, x in enumerate(near):
        x.open(64 * k + b for j, k, _ in words if j == i for b in range(64) if (seen.get[f"w{i}_{k}"] or 0) >> b & 1)
    return out


def unit_digests(edges: DataFrame, direct: DataFrame) -> DataFrame:
    """fn, digest: what each unit is made of, its calls (caller, callee; each once) and its own effects (fn, mask), in any
    order. Calls are added up by hashes, as halves of 32 bits, so a unit of many calls isn't gathered anywhere."""
    halves = lambda h: (h.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftrightunsigned(h, 32))
    sums = [F.lit(1).cast("long"), *halves(F.xxhash64("callee")), *halves(F.xxhash64(F.lit("b"), "callee"))]
    names = [f"s{i}" for i in range(len(sums))]
    calls = edges.select(F.col("caller").alias("fn"), *[c.alias(x) for c, x in zip(sums, names)], F.lit(0).alias("mask"))
    own = direct.select("fn", *[F.lit(0).cast("long").alias(x) for x in names], "mask")
    both = calls.unionByName(own).groupBy("fn").agg(*[F.sum(x).alias(x) for x in names], F.bit_or("mask").alias("mask"))
    return both.select("fn", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in (*names, "mask")]), 256).alias("digest"))


def changed_units(old: DataFrame, new: DataFrame) -> DataFrame:
    """fn of units whose digests differ or that only one side has."""
    both = old.join(new.withColumnRenamed("digest", "now"), "fn", "full_outer")
    return both.filter(~F.col("digest").eqNullSafe(F.col("now"))).select("fn")


def _united(rows: DataFrame) -> DataFrame:
    return rows.groupBy("fn").agg(F.bit_or("mask").alias("mask"))


def _less(rows: DataFrame, other: DataFrame, once: bool = False) -> DataFrame:
    """rows (fn, mask) without the bits that other (fn, mask) has; once: it has each function once."""
    had = (other if once else _united(other)).withColumnRenamed("mask", "_had")
    return rows.join(had, "fn", "left").withColumn("mask", F.expr("mask & ~coalesce(_had, 0)")).filter("mask <> 0").select("fn", "mask")


def _climb(seeds: DataFrame, calls: Opened, had: Opened, rounds: int) -> DataFrame:
    """What of seeds (fn, mask) and of what goes from them to callers is beyond what these have (had, each function once)."""
    found = Kept(seeds.sparkSession, ["fn"], calls.kept.n)
    # What a round brings is the small side: with a table of it, neither calls nor what is had need be sorted.
    small = lambda rows: rows.hint("shuffle_hash")
    try:
        first = _noted(_united(seeds).filter("mask <> 0"), stored, had)
        n = _noted(_less(small(first), had.all(), True), found.add, calls)
        for _ in range(rounds):
            if not n:
                return stored(_united(found.all()))
            got = _united(calls.all().join(small(found.new().withColumnRenamed("fn", "callee")), "callee").select(F.col("caller").alias("fn"), "mask"))
            got = got if had.whole else _noted(got, stored, had)
            n = _noted(_less(small(_less(small(got), had.all(), True)), found.all()), found.add, calls)
            if found.rounds % 8 == 0:
                found.merge()
    finally:
        found.close()
    raise RuntimeError(f"no end after {rounds} rounds")


def refresh(known: Folders, old: Folders, new: Folders, made: Folders, direct: Folders, lost_calls: DataFrame, new_calls: DataFrame, lost: DataFrame, gained: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """fn, mask of every function whose effects are touched by a change, as the whole fixpoint would have it.

    known: fn, mask before, by fn; old, new: caller, callee before and after, by callee; made: those after, by caller;
    direct: fn, mask after, by fn; lost_calls, new_calls: caller, callee; lost, gained: fn, mask of own effects. Functions that aren't returned keep
    what they had; a function with no effects left has mask 0.
    """
    spark = known.rows.sparkSession
    through = lambda calls, rows: calls.join(rows.withColumnRenamed("fn", "callee"), "callee").select(F.col("caller").alias("fn"), "mask")

    n = buckets(spark, old.rows.count() + new.rows.count())
    with shuffles(spark, n), ExitStack() as ends:
        opened = lambda *a: ends.enter_context(Opened(a[0], n, *a[1:]))
        lost_calls = stored(lost_calls)
        brought = through(lost_calls, known.near(lost_calls.select(F.col("callee").alias("fn"))))
        gone = _climb(lost.unionByName(brought), opened(old), opened(direct), rounds)

        # Of what was taken away, bits that a call after the change still brings from what is left beyond doubt.
        left = opened(known, gone)
        calls = _noted(made.near(gone).join(gone.select(F.col("fn").alias("caller")), "caller"), stored, left, key="callee")
        new_calls = _noted(new_calls, stored, left, key="callee")
        back = through(calls, left.all()).join(gone.withColumnRenamed("mask", "_gone"), "fn").withColumn("mask", F.expr("mask & _gone")).select("fn", "mask")
        fresh = gained.unionByName(through(new_calls, left.all())).unionByName(back)
        added = _climb(fresh, opened(new), left, rounds)

        touched = _noted(gone.select("fn").union(added.select("fn")).distinct(), stored, left)
        rows = touched.join(left.all(), "fn", "left").join(added.withColumnRenamed("mask", "_new"), "fn", "left")
        return stored(rows.select("fn", F.expr("coalesce(mask, 0) | coalesce(_new, 0)").alias("mask")))


def applied(known: Folders, touched: DataFrame) -> Folders:
    """The fixpoint with touched functions (fn, mask) put in: their folders are written anew, the others stay where they
    lie."""
    parts = known.parts(touched)
    had = known.of(parts).join(touched.select("fn"), "fn", "left_anti")
    again = Folders.write(had.unionByName(touched.filter("mask <> 0").select(had.columns)), known.on, known.n)
    return Folders(known.rows.filter(~F.col("part").isin(parts)).unionByName(again.rows), known.on, known.n)
