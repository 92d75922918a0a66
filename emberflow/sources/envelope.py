"""What a report says about itself: producer, packages, coverage, completeness; and whole documents written.

The object that names the producer stands under a key of the format, given as `head`.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberflow.sources.report import heads, in_lines, report_lines

# Keys of the envelope, their types, and the names of our columns.
KEYS = (
    ("packages", "packages", "array<string>"),
    ("analyzed.count", "n_analyzed", "long"),
    ("analyzed.digest", "digest", "string"),
    ("resolves", "resolves", "array<string>"),
    ("switches", "switches", "array<string>"),
    ("unanalyzed", "unanalyzed", "array<struct<path:string,reason:string>>"),
    ("excluded", "excluded", "array<struct<class:string,count:long,peeked:boolean,reason:string>>"),
    ("outOfScope", "out_of_scope", "array<struct<fn:string,path:string,effects:array<string>,class:string,reason:string>>"),
    ("scannedUnder.deny", "scanned_under", "array<string>"),
    ("netPartners.hosts", "partners", "array<string>"),
    ("coverage.uncovered", "uncovered", "array<struct<name:string,calls:long>>"),
)


def envelopes(spark: SparkSession, paths: list[str], head: str = "producer") -> DataFrame:
    """One row a report: report, version, toolchain, spec and the columns of KEYS; null where a key is absent, so an
    empty list and a list that isn't there differ. A bare array of functions has nulls only."""
    lined, whole = in_lines(spark, paths)
    docs = heads(spark, lined).select("report", F.try_parse_json("json").alias("doc")) if lined else None
    if whole or not lined:
        more = spark.read.text(whole, wholetext=True).select(F.col("_metadata.file_path").alias("report"), F.try_parse_json("value").alias("doc"))
        docs = more if docs is None else docs.unionByName(more)
    get = lambda key, kind: F.expr(f"CASE WHEN startswith(schema_of_variant(doc), 'OBJECT') THEN try_variant_get(doc, '$.{key}', '{kind}') END")
    return docs.select("report", *[get(f"{head}.{k}", "string").alias(k) for k in ("version", "toolchain", "spec")], *[get(k, t).alias(n) for k, n, t in KEYS])


def coverage_delta(now: DataFrame, base: DataFrame) -> DataFrame:
    """name, change: packages that became uncovered (now) or no longer are (gone), from two frames of envelopes."""
    names = lambda e: e.select(F.explode("uncovered.name").alias("name")).distinct()
    a, b = names(now), names(base)
    return a.join(b, "name", "left_anti").withColumn("change", F.lit("now")).unionByName(b.join(a, "name", "left_anti").withColumn("change", F.lit("gone")))


def unlike(now: DataFrame, base: DataFrame) -> DataFrame:
    """what, now, base: version and toolchain where two reports differ, so that a difference may be the producer's."""
    one = lambda e, n: e.agg(F.min("version").alias(f"v{n}"), F.min("toolchain").alias(f"t{n}"))
    both = one(now, 0).crossJoin(one(base, 1))  # one row each
    rows = both.select(F.explode(F.array(F.struct(F.lit("version").alias("what"), F.col("v0").alias("now"), F.col("v1").alias("base")), F.struct(F.lit("toolchain").alias("what"), F.col("t0").alias("now"), F.col("t1").alias("base")))).alias("r")).select("r.*")
    return rows.filter(~F.col("now").eqNullSafe(F.col("base")))


def switches(reports: DataFrame) -> DataFrame:
    """switch: the switches that moved the result of any of these reports, in code-point order."""
    return reports.select(F.explode("switches").alias("switch")).filter("switch <> ''").distinct().orderBy("switch")


def switched_dependencies(reports: DataFrame) -> DataFrame:
    """report, switches: dependency reports that were made under a switch."""
    rows = reports.select("report", F.explode("switches").alias("switch")).filter("switch <> ''")
    return rows.groupBy("report").agg(F.array_sort(F.collect_set("switch")).alias("switches"))


def unasked(reports: DataFrame, asked: list[str]) -> DataFrame:
    """rule: canonical deny rules which a producing scan that peeked into excluded files wasn't asked."""
    peeked = reports.filter(F.coalesce(F.exists("excluded", lambda x: x["peeked"]), F.lit(False)))
    rules = F.broadcast(reports.sparkSession.createDataFrame([(r,) for r in asked], "rule string"))  # lines of a file
    wants = peeked.select("report").crossJoin(rules)
    held = peeked.select("report", F.explode("scanned_under").alias("rule"))
    return wants.join(held, ["report", "rule"], "left_anti").select("rule").distinct()


def says_incomplete(c: str = "unanalyzed") -> Column:
    """A report that names units it couldn't analyze."""
    return F.coalesce(F.size(c) > 0, F.lit(False))


def judged_nothing(n_functions: Column) -> Column:
    """A report that claims no analyzed unit; without a manifest, one without functions."""
    return F.when(F.col("n_analyzed").isNull(), F.coalesce(n_functions, F.lit(0)) == 0).otherwise(F.col("n_analyzed") <= 0)


def completeness(reports: DataFrame) -> DataFrame:
    """One row over a set of reports: n_reports, what they left unanalyzed, out of scope or unread, and whether the set
    is incomplete."""
    some = lambda c: F.flatten(F.collect_list(F.coalesce(c, F.array().cast(reports.schema[c].dataType)))).alias(c)
    unread = F.filter("excluded", lambda x: ~F.coalesce(x["peeked"], F.lit(False)))
    out = reports.agg(F.count("*").alias("n_reports"), some("unanalyzed"), some("out_of_scope"), F.sum(F.coalesce(F.size(unread), F.lit(0))).alias("n_unread"))
    return out.withColumn("incomplete", (F.size("unanalyzed") > 0) | (F.size("out_of_scope") > 0) | (F.coalesce("n_unread", F.lit(0)) > 0))


def label(packages: list[str]) -> str | None:
    """The dotted name that all packages begin with; None for none or nothing shared."""
    cut = [p.split(".") for p in packages]
    n = 0
    while cut and n < min(map(len, cut)) and len({c[n] for c in cut}) == 1:
        n += 1
    return ".".join(cut[0][:n]) or None if cut else None


def _move(spark: SparkSession, source: str, target: str) -> bool:
    """The one part file of a folder becomes target, unless target holds the same bytes; whether it was written. It takes
    the old one's place in one step where the store can do that, so a reader finds one of the two at any time."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf, to = spark._jsc.hadoopConfiguration(), hadoop.Path(target)
    fs = to.getFileSystem(conf)
    part = next(s.getPath() for s in fs.listStatus(hadoop.Path(source)) if s.getPath().getName().startswith("part-"))
    same = fs.exists(to) and spark.read.format("binaryFile").load([str(part), target]).select(F.sha2("content", 256)).distinct().count() == 1
    if not same:
        over = spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        over[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(part), fs.makeQualified(to), over)
    fs.delete(hadoop.Path(source), True)
    return not same


def _one_task(lines: DataFrame, key: str) -> DataFrame:
    """Lines (key, json) in order of the key in one task, with a row without json that makes sure there is one."""
    mark = lines.sparkSession.range(1).select(F.lit("").alias(key), F.lit(None).cast("string").alias("json"))
    return lines.select(key, "json").unionByName(mark).repartitionByRange(1, key).sortWithinPartitions(key)


def write_report(functions: DataFrame, path: str, envelope: dict, head: str = "producer") -> bool:
    """Write one report document: the envelope's keys in order, then the functions by name. The file appears whole, and
    one that holds the same bytes stays as it is; whether it was written.

    The rows pass one task as a stream, as the format is one file a module; a module's functions, not a corpus.
    """
    spark = functions.sparkSession
    top = ", ".join(f"{json.dumps(k if k != 'head' else head)}: {json.dumps(v)}" for k, v in envelope.items())
    rows = _one_task(report_lines(functions), "fn").select("json")

    def document(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array(["{" + top + (", " if top else "") + '"functions": ['])], ["value"])
        held = None
        for b in batches:
            lines = [x for x in b["json"].to_pylist() if x is not None]
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([x + "," for x in ([] if held is None else [held]) + lines[:-1]], pa.string())], ["value"])
                held = lines[-1]
        yield pa.RecordBatch.from_arrays([pa.array([(held or "") + "]}"])], ["value"])

    folder = f"{path}.{uuid.uuid4().hex}"
    rows.mapInArrow(document, "value string").write.text(folder)
    return _move(spark, folder, path)


def write_pairs(lines: DataFrame, path: str) -> bool:
    """Write a sidecar, one JSON object, from its members (source, json); as write_report does."""
    rows = _one_task(lines, "source").select("source", "json")

    def document(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array(["{"])], ["value"])
        held = None
        for b in batches:
            lines = [f"{json.dumps(s)}: {t}" for s, t in zip(b["source"].to_pylist(), b["json"].to_pylist()) if t is not None]
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([x + "," for x in ([] if held is None else [held]) + lines[:-1]], pa.string())], ["value"])
                held = lines[-1]
        yield pa.RecordBatch.from_arrays([pa.array([(held or "") + "}"])], ["value"])

    folder = f"{path}.{uuid.uuid4().hex}"
    rows.mapInArrow(document, "value string").write.text(folder)
    return _move(lines.sparkSession, folder, path)
