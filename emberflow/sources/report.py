"""Report documents, their sidecars and runtime traces as frames, and back.

A report is one JSON document: an envelope with functions, or a bare array of them. Reading is strict: a key that is
there with another type than its own refuses the document, an absent one takes its default; loc and hash are
lenient. Documents are parsed once as variants, so absent, null and wrong types can be told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberflow.sources.locate import Store, decoded

# Keys of a function by type, in the order in which they are written.
TEXTS = ("fn", "loc", "hash", "unitKind")
FLAGS = ("entryPoint", "unresolved", "interfaceUnion")
LISTS = ("inferred", "direct", "declared", "undeclared", "overdeclared", "invisible", "unknownWhy", "calls", "fs", "hosts", "cmds", "paths", "tables", "netClass", "incomplete", "dispatchesOn")
LENIENT = ("loc", "hash")


class ReportRefused(ValueError):
    """A document that isn't a report."""


def _stripped(n: int) -> Column:
    return F.expr(f"left(v, length(v) - {n})")


def _lines(spark: SparkSession, paths: list[str], sidecar: bool) -> DataFrame:
    """report, part, json and place of the lines of documents: head, rest (one member or function a line, with a comma
    behind it), last, or null for any other line; json: the head's or the line's own JSON object."""
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("report"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"), F.rtrim("value").alias("v"))
    end = "}" if sidecar else "]}"
    if sidecar:
        head = F.when(F.col("v") == "{", "{}")
        own = lambda n: F.when(F.startswith("v", F.lit('"')), F.concat(F.lit("{"), _stripped(n), F.lit("}")))
    else:
        head = F.when(F.endswith("v", F.lit('"functions": [')), F.concat("v", F.lit("]}")))
        own = lambda n: F.when(F.startswith("v", F.lit("{")), _stripped(n))
    rest, last = F.when(F.endswith("v", F.lit(",")), own(1)), F.when(F.col("v") == end, F.lit("")).when(F.endswith("v", F.lit(end)), own(len(end)))
    sound = lambda c: F.try_parse_json(c).isNotNull()
    part = F.when(sound(head), "head").when(sound(rest), "rest").when((last == "") | sound(last), "last")
    return rows.select("report", "place", part.alias("part"), F.coalesce(head, rest, last).alias("json"))


def in_lines(spark: SparkSession, paths: list[str], sidecar: bool = False) -> tuple[list[str], list[str]]:
    """The paths of documents with one member or function a line, as they are written here, and the others.

    Spark splits the former where a line ends, so no task holds a document; each of their lines is sound JSON by itself,
    the first opens the document and the last closes it. Others are read whole, a document in a row.
    """
    if not paths:
        return [], []
    is_ = lambda part: F.coalesce(F.col("part") == part, F.lit(False))
    ends = _lines(spark, paths, sidecar).groupBy("report").agg(F.min_by(is_("head"), "place").alias("opens"), F.max_by(is_("last"), "place").alias("closes"), F.count(F.when(~is_("rest"), 1)).alias("n"))
    # One row a document.
    good = {r["f"] for r in ends.filter("opens and closes and n = 2").select(decoded(F.col("report")).alias("f")).collect()}
    full = Store(spark).full
    return [p for p in paths if full(p) in good], [p for p in paths if full(p) not in good]


def pieces(spark: SparkSession, paths: list[str], sidecar: bool = False) -> DataFrame:
    """report, json: the members (as objects) or functions of documents in lines."""
    return _lines(spark, paths, sidecar).filter("part in ('rest', 'last') and json <> ''").select("report", "json")


def heads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """report, json: documents in lines without their functions."""
    return _lines(spark, paths, False).filter("part = 'head'").select("report", "json")


def _rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    lined, paths = in_lines(spark, paths)
    out = pieces(spark, lined).select("report", F.try_parse_json("json").alias("f")) if lined else None
    whole = _whole(spark, paths) if paths or not lined else None
    return whole if out is None else out if whole is None else out.unionByName(whole)


def _whole(spark: SparkSession, paths: list[str]) -> DataFrame:
    docs = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("report"), F.try_parse_json("value").alias("doc"))
    broken = docs.filter("doc is null").select("report").first()
    if broken:
        raise ReportRefused(f"{broken['report']} is no JSON")
    picked = docs.select("report", F.expr("CASE WHEN startswith(schema_of_variant(doc), 'ARRAY') THEN doc ELSE try_variant_get(doc, '$.functions', 'variant') END").alias("functions"))
    return spark.sql("SELECT report, f.value AS f FROM {picked}, LATERAL variant_explode(functions) AS f", picked=picked)


def read_functions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row a function of all reports, ordered by nothing: report and the typed keys.

    Rows without fn are dropped; a document whose rows are all dropped, or that holds a key of a wrong type, raises
    ReportRefused.
    """
    rows = _rows(spark, paths)
    for key in (*TEXTS, *FLAGS, *LISTS):
        rows = rows.withColumn(f"_{key}", F.expr(f"schema_of_variant(try_variant_get(f, '$.{key}', 'variant'))"))
    allowed = {**{k: ("STRING",) for k in TEXTS}, **{k: ("BOOLEAN",) for k in FLAGS}, **{k: ("ARRAY<STRING>", "ARRAY<VOID>") for k in LISTS}}
    wrong = F.array(*[F.when(F.col(f"_{k}").isNotNull() & ~F.col(f"_{k}").isin(*kinds), F.lit(k)) for k, kinds in allowed.items() if k not in LENIENT])
    bad = rows.withColumn("_bad", F.array_compact(wrong)).filter("size(_bad) > 0").select("report", "_bad").first()
    if bad:
        raise ReportRefused(f"{bad['report']}: wrong type of {', '.join(bad['_bad'])}")
    get = lambda k, kind: F.expr(f"try_variant_get(f, '$.{k}', '{kind}')")
    out = rows.select("report", *[F.coalesce(get(k, "string"), F.lit("function" if k == "unitKind" else "")).alias(k) for k in TEXTS], *[F.coalesce(get(k, "boolean"), F.lit(False)).alias(k) for k in FLAGS], *[F.coalesce(get(k, "array<string>"), F.array().cast("array<string>")).alias(k) for k in LISTS])
    empty = out.groupBy("report").agg(F.count(F.when(F.col("fn") != "", 1)).alias("n")).filter("n = 0").select("report").first()
    if empty:
        raise ReportRefused(f"{empty['report']}: no row names a function")
    return out.filter("fn <> ''")


def unit_key(functions: DataFrame) -> DataFrame:
    """functions with key: the hash, or the name where there is none."""
    return functions.withColumn("key", F.when(F.col("hash") != "", F.col("hash")).otherwise(F.col("fn")))


def read_pairs(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, bool]:
    """(source, target) and (source) of sidecars that map names to lists of names, and whether one was unreadable.

    Keys that begin with @ are left out; a key with an empty list has no pair but is there.
    """
    lined, whole = in_lines(spark, paths, sidecar=True)
    kind, none = "map<string,array<string>>", F.lit(False).alias("broken")
    docs = pieces(spark, lined, sidecar=True).select(F.from_json("json", kind).alias("m"), none) if lined else None
    if whole or not lined:
        more = spark.read.text(whole, wholetext=True).select(F.from_json("value", kind).alias("m"), F.try_parse_json("value").isNull().alias("broken"))
        docs = more if docs is None else docs.unionByName(more)
    partial = docs.filter("broken or m is null").count() > 0
    rows = docs.select(F.explode("m").alias("source", "targets")).filter("not startswith(source, '@')")
    return rows.select("source", F.explode("targets").alias("target")).distinct(), rows.select("source").distinct(), partial


def read_superclasses(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(type, super) of the flat list of pairs under @superclass."""
    docs = spark.read.text(paths, wholetext=True).select(F.from_json("value", "map<string,array<string>>")["@superclass"].alias("flat"))
    rows = docs.select(F.posexplode("flat").alias("i", "name"), F.col("flat"))
    return rows.filter("i % 2 = 0").select(F.col("name").alias("type"), F.expr("element_at(flat, i + 2)").alias("super"))


def read_trace(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Observations (fn, effect) of NDJSON lines, and the number of torn lines (n)."""
    raw = spark.read.text(path).filter("trim(value) <> ''").select(F.from_json("value", "fn string, effect string").alias("r"))
    torn = F.col("r").isNull() | F.col("r.fn").isNull() | F.col("r.effect").isNull()
    return raw.filter(~torn).select("r.fn", "r.effect"), raw.agg(F.count(F.when(torn, 1)).alias("n"))


def report_lines(functions: DataFrame) -> DataFrame:
    """One JSON text a function (json), keys in fixed order, optional empty ones left out."""
    always = ("fn", "loc", "inferred", "direct", "declared", "undeclared", "overdeclared", "entryPoint", "unresolved", "hash")
    cols = []
    for key in (*always, *[k for k in (*TEXTS, *FLAGS, *LISTS) if k not in always]):
        c = F.col(key)
        if key not in always:
            c = F.when(F.size(c) > 0, c) if key in LISTS else F.when(c != "function", c) if key == "unitKind" else F.when(c, c)
        cols.append(c.alias(key))
    return functions.select("fn", F.to_json(F.struct(*cols), {"ignoreNullFields": "true"}).alias("json"))


def pair_lines(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One JSON member a source (source, json), with its sorted distinct targets; sources without any included."""
    lists = pairs.groupBy("source").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    rows = nodes.select("source").distinct().join(lists, "source", "left")
    return rows.select("source", F.to_json(F.coalesce("targets", F.array().cast("array<string>"))).alias("json"))
