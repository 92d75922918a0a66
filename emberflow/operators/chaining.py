"""Reports chained as dependencies, open dispatch frontiers, ledgers and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberflow.functions import names as N
from emberflow.functions.effects import BIT, bit_of
from emberflow.operators.fixpoint import reach
from emberflow.operators.verbs import told


def dependency_functions(rows: DataFrame, version: str) -> DataFrame:
    """hash, mask, reason of dependency rows (hash, version, mask, why): those of another version than `version` say
    Unknown only, with the reason dep-stale:; an Unknown without a reason gets dep:. Rows of one hash are united and
    stale only if all are."""
    stale = F.col("version") != version
    united = rows.groupBy("hash").agg(F.bit_or(F.when(stale, BIT["Unknown"]).otherwise(F.col("mask"))).alias("mask"), F.every(stale).alias("stale"), F.min("why").alias("why"))
    unknown = F.col("mask").bitwiseAND(BIT["Unknown"]) != 0
    reason = F.when(~unknown, None).when(F.col("stale"), F.concat(F.lit("dep-stale:"), "hash")).otherwise(F.coalesce("why", F.concat(F.lit("dep:"), "hash")))
    return united.select("hash", "mask", reason.alias("reason"))


def inherit_from_dependencies(calls: DataFrame, dependencies: DataFrame) -> DataFrame:
    """fn, mask that functions take over from the dependency functions they call; calls: fn, hash. Calls of hashes
    that no dependency declares give nothing."""
    return calls.join(dependencies, "hash").groupBy("fn").agg(F.bit_or("mask").alias("mask"))


def subtype_answers(asked: DataFrame, supers: DataFrame, indexed: DataFrame) -> DataFrame:
    """type, of, answer: YES if `of` is reached over supertypes, UNANSWERABLE if a type on the way was never indexed,
    else NO; a YES stands whatever else is unknown. asked: type, of; supers: type, super; indexed: type."""
    seeds = asked.select(F.col("type").alias("source"), F.col("type").alias("node"), F.lit(0).alias("hops")).distinct()
    above = reach(supers.select(F.col("type").alias("src"), F.col("super").alias("dst")), seeds)
    seen = above.join(indexed.select(F.col("type").alias("node"), F.lit(True).alias("known")), "node", "left")
    open_ = seen.groupBy(F.col("source").alias("type")).agg(F.max(F.col("known").isNull()).alias("open"))
    yes = above.select(F.col("source").alias("type"), F.col("node").alias("of"), F.lit(True).alias("yes")).distinct()
    rows = asked.select("type", "of").distinct().join(yes, ["type", "of"], "left").join(open_, "type")
    return rows.select("type", "of", F.when(F.col("yes"), "YES").when(F.col("open"), "UNANSWERABLE").otherwise("NO").alias("answer"))


def dispatch_frontier(reasons: DataFrame, bodies: DataFrame, supers: DataFrame, indexed: DataFrame) -> DataFrame:
    """fn, via: functions with an unresolved dispatch (reasons: fn, why as dispatch:owner.method) that may run one of
    the bodies (fn): same method, and the body's type is, or may be, a subtype of the owner."""
    open_ = reasons.filter("startswith(why, 'dispatch:')").select("fn", F.substring("why", 10, 1 << 20).alias("target"))
    open_ = open_.select("fn", N.simple_method(F.col("target")).alias("via"), F.when(F.instr("target", ".") > 0, N.declaring_type(F.col("target"))).alias("owner"))
    own = bodies.select(N.simple_method(F.col("fn")).alias("via"), N.declaring_type(F.col("fn")).alias("type")).distinct()
    pairs = open_.join(own, "via")
    told = subtype_answers(pairs.filter("owner is not null").select("type", F.col("owner").alias("of")), supers, indexed)
    rows = pairs.join(told.withColumnRenamed("of", "owner"), ["type", "owner"], "left")
    return rows.filter("owner is null or answer <> 'NO'").select("fn", "via").distinct()


def reason_histogram(reasons: DataFrame) -> DataFrame:
    """prefix, tag, n of reasons, by the text before the first colon and in full."""
    return reasons.groupBy(F.substring_index("why", ":", 1).alias("prefix"), F.col("why").alias("tag")).agg(F.count("*").alias("n"))


def coverage_ledger(calls: DataFrame, covered: DataFrame) -> DataFrame:
    """package, calls: calls of packages that no dependency covers; calls: package; covered: package."""
    return calls.groupBy("package").agg(F.count("*").alias("calls")).join(covered, "package", "left_anti")


def conformance(functions: DataFrame, declared: DataFrame) -> DataFrame:
    """cls, undeclared, overdeclared: effects that a class's functions perform or reach but it doesn't declare, and
    the reverse; functions: fn, mask; declared: cls, effect."""
    said = declared.groupBy("cls").agg(F.bit_or(bit_of(F.col("effect"))).alias("said"))
    done = functions.groupBy(N.declaring_type(F.col("fn")).alias("cls")).agg(F.bit_or("mask").alias("done"))
    rows = said.join(done, "cls", "left").withColumn("done", F.coalesce("done", F.lit(0)).bitwiseAND(~BIT["Unknown"]))
    return rows.select("cls", told(F.expr("done & ~said")).alias("undeclared"), told(F.expr("said & ~done")).alias("overdeclared"))


def digest(names: DataFrame, n_parts: int = 64) -> DataFrame:
    """n, digest: how many distinct names there are, and a digest of the set.

    Hashes of the names are added up by part, so no task holds all names and order doesn't matter; it tells two sets
    apart and isn't any other tool's number.
    """
    each = names.select("name").distinct().withColumn("h", F.sha2("name", 256)).withColumn("part", F.pmod(F.xxhash64("name"), F.lit(n_parts)))
    sums = each.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)")).alias("s"))
    return sums.agg(F.sum("n").alias("n"), F.sha2(F.sum("s").cast("string"), 256).alias("digest"))


# Words that begin a statement, that a table's name follows, that may stand between, and that are no names.
STATEMENTS = ("select", "insert", "update", "delete", "create", "drop", "alter", "truncate", "merge", "replace", "with")
BEFORE_TABLES = ("from", "join", "into", "table")
BETWEEN = ("only", "if", "not", "exists", "table")
NO_NAMES = (
    "select set where values on using group order by limit returning as inner outer left right cross lateral natural union all distinct case when null "
    "default skip nowait of from join into update delete insert"
).split()
#: States of the reader: nothing awaited, a name after a keyword, a comma after a name, a name after a comma, and a comma or
#: a name, as what was read is both a name and a keyword.
IDLE, NAME, COMMA, MORE, EITHER = range(5)


def tables_in_sql(sql: Column) -> Column:
    """Sorted distinct tables that a statement names, read word by word; none of a text that doesn't begin as one.

    A name is taken after FROM, JOIN, INTO, TABLE and a leading UPDATE or TRUNCATE, and after a comma that follows such a
    name directly: behind an alias a list isn't followed, as its commas could be those of columns.
    """
    words = F.split(F.trim(F.regexp_replace(F.replace(F.regexp_replace(F.lower(sql), "[();]", " "), F.lit(","), F.lit(" , ")), r"\s+", " ")), " ")
    none = F.array().cast("array<string>")

    def named(word: Column) -> Column:
        bare = F.regexp_replace(word, "^[\"'`]+|[\"'`]+$", "")
        return F.when(bare.rlike("^[a-z_][a-z0-9_.$\"`]*$") & ~bare.isin(*NO_NAMES), F.regexp_replace(bare, "[\"`]", ""))

    def read(at: Column, word: Column) -> Column:
        mode, name = at["mode"], named(word)
        awaited = mode.isin(NAME, MORE, EITHER)
        skipped = mode.isin(NAME, EITHER) & word.isin(*BETWEEN)
        comma = mode.isin(COMMA, EITHER) & (word == ",")
        taken = awaited & ~skipped & ~comma & name.isNotNull()
        keyword = word.isin(*BEFORE_TABLES)
        after = F.when(skipped, F.lit(NAME)).when(comma, F.lit(MORE)).when(taken, F.when(keyword, F.lit(EITHER)).otherwise(F.lit(COMMA))).when(keyword, F.lit(NAME)).otherwise(F.lit(IDLE))
        return F.struct(after.alias("mode"), F.when(taken, F.concat(at["found"], F.array(name))).otherwise(at["found"]).alias("found"))

    first = F.element_at(words, 1)
    start = F.struct(F.when(first.isin("update", "truncate"), F.lit(NAME)).otherwise(F.lit(IDLE)).alias("mode"), none.alias("found"))
    found = F.aggregate(F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), start, read)["found"]
    return F.when(first.isin(*STATEMENTS), F.array_sort(F.array_distinct(found))).otherwise(none)
