"""Reports of dependencies: their functions, types, call graphs that belong to them, and what they leave open."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberflow.functions.effects import BIT
from emberflow.sources.envelope import envelopes, judged_nothing, says_incomplete
from emberflow.sources.locate import Store, decoded, is_sidecar, sidecar
from emberflow.sources.report import in_lines, pieces, read_functions

# Start and factor of the 64-bit FNV-1a digest.
FNV_START, FNV_FACTOR = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(names: DataFrame) -> DataFrame:
    """report, n, digest: how many distinct names (report, name) each report has, and the FNV-1a digest of them in order,
    each followed by a line end, as 16 hexadecimal digits.

    The digest depends on the order, so a report's names pass one task, as a sorted stream of which nothing is kept.
    """

    def run(batches):
        at, n, h = None, 0, FNV_START
        for b in batches:
            for report, name in zip(b["report"].to_pylist(), b["name"].to_pylist()):
                if report != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([n]), pa.array([f"{h:016x}"])], ["report", "n", "digest"])
                    at, n, h = report, 0, FNV_START
                n += 1
                for x in name.encode() + b"\n":
                    h = (h ^ x) * FNV_FACTOR & 0xFFFFFFFFFFFFFFFF
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([n]), pa.array([f"{h:016x}"])], ["report", "n", "digest"])

    rows = names.select("report", "name").distinct().repartition("report").sortWithinPartitions("report", "name")
    return rows.mapInArrow(run, "report string, n long, digest string")


def dependency_paths(spark: SparkSession, given: str) -> list[str]:
    """Report files of a list of paths parted by : or of a folder; sidecars are left out."""
    store, out = Store(spark), []
    for path in [p for p in (given.split(":") if "://" not in given else [given]) if p]:
        if store.is_dir(path):
            out += sorted(f"{path.rstrip('/')}/{n}" for n in store.names(path) if n.endswith(".json") and not is_sidecar(n))
        else:
            out.append(path)
    return list(dict.fromkeys(out))


def dependency_rows(spark: SparkSession, paths: list[str], head: str = "producer") -> DataFrame:
    """hash, version, mask, why of the functions of dependency reports, as chaining.dependency_functions takes them; an
    effect outside the vocabulary counts as Unknown, and a row without a hash can't be called."""
    rows = read_functions(spark, paths).join(envelopes(spark, paths, head).select("report", F.coalesce("version", F.lit("")).alias("version")), "report")
    pairs = F.create_map(*[x for e, b in BIT.items() for x in (F.lit(e), F.lit(b))])
    bits = F.transform("inferred", lambda e: F.coalesce(F.element_at(pairs, e), F.lit(BIT["Unknown"])))
    mask = F.aggregate(bits, F.lit(0), lambda a, b: a.bitwiseOR(b))
    return rows.filter("hash <> ''").select("hash", "version", mask.alias("mask"), F.when(F.size("unknownWhy") > 0, F.array_min("unknownWhy")).alias("why"))


def own_types(spark: SparkSession, paths: list[str]) -> DataFrame:
    """report, type: the types that each report's hierarchy sidecar has a key for; reports without one have no rows."""
    store = Store(spark)
    sides = {sidecar(p, "hierarchy"): p for p in paths if store.is_file(sidecar(p, "hierarchy"))}
    if not sides:
        return spark.createDataFrame([], "report string, type string")
    return _keys(spark, sides).filter("not startswith(name, '@')").select("report", F.col("name").alias("type"))


def _keys(spark: SparkSession, sides: dict[str, str]) -> DataFrame:
    """report, name: the keys of sidecars; files are told by their whole paths."""
    full = Store(spark).full
    of = F.broadcast(spark.createDataFrame([(full(s), p) for s, p in sides.items()], "_f string, report string"))  # one a report
    lined, whole = in_lines(spark, list(sides), sidecar=True)
    docs = pieces(spark, lined, sidecar=True).withColumnRenamed("json", "value") if lined else None
    if whole or not lined:
        more = spark.read.text(whole, wholetext=True).select(F.col("_metadata.file_path").alias("report"), "value")
        docs = more if docs is None else docs.unionByName(more)
    docs = docs.select(decoded(F.col("report")).alias("_f"), F.explode(F.map_keys(F.from_json("value", "map<string,array<string>>"))).alias("name"))
    return docs.join(of, "_f").select("report", "name")


def paired_callgraphs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """report, paired, n, digest: of reports with a call-graph sidecar, whether it is the one of the report: its names
    must be as many as the report says it analyzed and have the digest that it tells. A sidecar without names has the
    digest of none; a path given twice is one report."""
    store = Store(spark)
    once = {store.full(p): p for p in reversed(paths)}
    sides = {sidecar(p, "callgraph"): p for p in once.values() if store.is_file(sidecar(p, "callgraph"))}
    if not sides:
        return spark.createDataFrame([], "report string, paired boolean, n long, digest string")
    of = F.broadcast(spark.createDataFrame([(store.full(p), p) for p in sides.values()], "_f string, report string"))  # one a report
    told = envelopes(spark, list(sides.values())).select(decoded(F.col("report")).alias("_f"), "n_analyzed", F.col("digest").alias("said")).join(of, "_f")
    both = told.join(fnv1a(_keys(spark, sides)), "report", "left")
    none = f"{FNV_START:016x}"
    both = both.select("report", "n_analyzed", "said", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("digest", F.lit(none)).alias("digest"))
    return both.select("report", F.coalesce((F.col("n") == F.col("n_analyzed")) & (F.col("digest") == F.col("said")), F.lit(False)).alias("paired"), "n", "digest")


def doubts(spark: SparkSession, paths: list[str], head: str = "producer") -> DataFrame:
    """report, incomplete, empty: of each dependency report, whether it names units it couldn't analyze, and whether it
    claims to have judged nothing. Packages that only such reports speak for aren't covered."""
    n = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("report"), F.try_parse_json("value").alias("doc"))
    n = n.select("report", F.expr("size(try_variant_get(CASE WHEN startswith(schema_of_variant(doc), 'ARRAY') THEN doc ELSE try_variant_get(doc, '$.functions', 'variant') END, '$', 'array<variant>'))").alias("_n"))
    return envelopes(spark, paths, head).join(n, "report").select("report", says_incomplete().alias("incomplete"), judged_nothing(F.col("_n")).alias("empty"))


def entry_package(hash_: str = "hash"):
    """The package of a hash owner/Class.method(desc)ret, with dots."""
    owner = F.substring_index(F.substring_index(hash_, "(", 1), ".", 1)
    return F.when(F.instr(owner, "/") > 0, F.replace(F.regexp_replace(owner, r"/[^/]*$", ""), F.lit("/"), F.lit("."))).otherwise("")
