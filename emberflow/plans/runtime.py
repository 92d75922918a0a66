"""Writing intermediate frames to the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir. Where the session names none, a temporary folder serves a local session;
    a cluster is refused, as its executors would write where others can't read."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="emberflow-"))
        top = spark.sparkContext.getCheckpointDir()
    return f"{top.rstrip('/')}/emberflow-{uuid.uuid4().hex}"


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Write and read again, and how many rows there are, counted by the same job."""
    path, seen = shared_dir(df.sparkSession), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]


def stored(df: DataFrame) -> DataFrame:
    """Write and read again: short lineage, and lost executors cost no more than the part at hand."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows a bucket holds at first.
ROWS = 50_000


class Kept:
    """Rows that grow round by round, in a table bucketed by the columns that tell them apart.

    What a round adds is appended to the buckets, so a join or an aggregate on these columns reads what is known where
    it lies, and only what is new is shuffled. Files are plain Parquet in the shared folder; the table's entry in the
    session's catalog goes with close(), and frames read before stay valid.
    """

    def __init__(self, spark: SparkSession, on: list[str], n: int | None = None):
        self.spark, self.on, self.rounds = spark, on, 0
        self.n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = self.path = ""

    def _write(self, rows: DataFrame) -> int:
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").bucketBy(self.n, *self.on).option("path", self.path).saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)
        return seen.get["n"]

    def _fresh(self) -> None:
        self.path = shared_dir(self.spark)
        self.name = os.path.basename(self.path).replace("-", "_")

    def add(self, rows: DataFrame) -> int:
        """Append rows as a new round; how many there were."""
        if not self.name:
            self._fresh()
        self.rounds += 1
        # A text, as generated code holds no texts and so is compiled once for all rounds.
        return self._write(rows.withColumn("_round", F.lit(str(self.rounds))))

    def all(self) -> DataFrame:
        return self.spark.table(self.name).drop("_round")

    def new(self) -> DataFrame:
        """Rows of the last round; files of earlier ones are passed over by their statistics."""
        return self.spark.table(self.name).filter(F.col("_round") == str(self.rounds)).drop("_round")

    def merge(self) -> None:
        """Write all buckets anew, a file each, without moving rows between them."""
        old, rows = self.name, self.spark.table(self.name)
        self._fresh()
        self._write(rows)
        self.spark.sql(f"DROP TABLE IF EXISTS {old}")

    def close(self) -> None:
        if self.name:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def buckets(spark: SparkSession, n_rows: int) -> int:
    """How many buckets so many rows are dealt into: as many as the session's shuffles have, fewer for few rows, as a round
    opens a file of each."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n_rows // ROWS + 1))


@contextmanager
def shuffles(spark: SparkSession, n: int) -> Iterator[None]:
    """Shuffles have n partitions meanwhile, as many as the buckets that they meet, which then needn't move."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def bucketed(rows: DataFrame, *on: str, n: int | None = None) -> Kept:
    """Rows dealt once into n buckets by `on`."""
    kept = Kept(rows.sparkSession, list(on), n)
    kept.add(rows.repartition(kept.n, *on))
    return kept
