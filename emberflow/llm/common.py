"""Helpers that the corpus operators share: tables, the shared folder, columns with safe names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of an input folder, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes in an Arrow batch.
BATCH_BYTES = 1 << 22


def ready(spark: SparkSession) -> SparkSession:
    """Make sure that a checkpoint folder is set and that Arrow batches are small enough for long texts.

    A folder named by the session is kept; without one, a temporary folder serves a local session, and a cluster is
    refused, as its executors would write where others can't read. Batches are bounded by BATCH_BYTES where the session
    has Spark's default of 64 MB or more: two batches at both ends of each worker would take much of an executor's
    memory beside the heap. The number of rows in a batch stays as it is.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="emberflow-"))
    return spark


#: Rows and bytes of one column that a function takes at once; texts may be long.
SOME_ROWS, SOME_BYTES = 512, 1 << 23


def small(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of batches with few rows and, but for single long rows, few bytes."""
    for b in batches:
        each = max(1, min(SOME_ROWS, SOME_BYTES * b.num_rows // max(1, b.nbytes)))
        for i in range(0, b.num_rows, each):
            yield b.slice(i, each)


def free_name(taken: Iterable[str], name: str) -> str:
    """name, with as many underscores after it as make it differ from those taken, in any case of letters."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path below the shared folder of this session."""
    ready(spark)
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{top.rstrip('/')}/emberflow-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it again: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def key_text(name: str = "doc_id") -> Column:
    """A key as text; a null key counts as the text 'null'."""
    return F.coalesce(F.col(name).cast("string"), F.lit("null"))


def parts(n_rows: int, rows_each: int, least: int = 1) -> int:
    """How many parts keep each near rows_each rows; it grows with the input and has no upper limit."""
    return max(least, -(-n_rows // rows_each))


def lowest(df: DataFrame, key: Column, most: int, n_rows: int, over: float = 4.0) -> DataFrame:
    """A bounded sample: at most `most` rows of df, the first in order of md5(key).

    Only rows whose md5 lies below over * most / n_rows of its range are ordered, so about over * most rows meet in
    one task however many n_rows of df are. Where filters of df keep fewer than 1 / over of them, the sample is
    smaller.
    """
    share = over * most / max(1, n_rows)
    rows = df.withColumn("_md5", F.md5(key))
    if share < 1:
        rows = rows.filter(F.conv(F.substring("_md5", 1, 8), 16, 10).cast("double") < share * 2**32)
    return rows.orderBy("_md5").limit(most).drop("_md5")


#: Ranges that an order is cut into: their bounds and sums go through the driver and one task.
RANGES = 4096


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], each: int = 100_000) -> DataFrame:
    """df with more columns: for each name the sum of its expression over all rows before, in the given order.

    Rows are cut into ranges, sums of ranges are added up first (at most RANGES rows in one task), and the rest is done
    within a range, so no task holds all rows. The frame is written once; ties must not matter or be told by `order`.
    """
    n = min(RANGES, parts(df.count(), each))
    rows = df.select("*", *[c.alias(f"_o{i}") for i, c in enumerate(order)]) if order else df
    keys = [F.col(f"_o{i}") for i in range(len(order))]
    rows = stored(rows.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()))
    each_range = rows.groupBy("_range").agg(*[F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums.values())])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(each_range.select("_range", *[F.sum(f"_s{i}").over(before).alias(f"_b{i}") for i in range(len(sums))]))
    own = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = rows.join(starts, "_range")
    return out.select(*df.columns, *[(zero(F.col(f"_b{i}")) + zero(F.sum(c).over(own))).alias(name) for i, (name, c) in enumerate(sums.items())])
