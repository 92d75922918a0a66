"""From relations to report rows: what is kept, how synthetic rows are made and merged, closed hierarchies, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberflow.functions import names as N
from emberflow.functions.effects import BIT
from emberflow.operators.fixpoint import reach, start, up, value_fixpoint

#: The kind of file access that stands for one that isn't known.
UNKNOWN_KIND = "?"


def dispatch_reach(edges: DataFrame, dispatching: DataFrame) -> DataFrame:
    """fn: the functions with an unresolved dispatch (fn) and all that reach one."""
    seeds = dispatching.select(F.lit("").alias("source"), F.col("fn").alias("node"), F.lit(0).alias("hops")).distinct()
    return reach(up(edges), seeds).select(F.col("node").alias("fn"))


def retained(functions: DataFrame, *others: DataFrame) -> DataFrame:
    """Functions that a report lists: with an effect, an entry point, or named by one of others (fn): reaching a package
    nothing is known of, with an incomplete surface, reaching an open dispatch, or of a class that declares effects."""
    marked = functions.withColumn("_keep", (F.col("mask") != 0) | F.col("entry_point"))
    for i, other in enumerate(others):
        marked = marked.join(other.select("fn").distinct().withColumn(f"_k{i}", F.lit(True)), "fn", "left").withColumn("_keep", F.col("_keep") | F.coalesce(f"_k{i}", F.lit(False))).drop(f"_k{i}")
    return marked.filter("_keep").drop("_keep")


def retained_calls(edges: DataFrame, functions: DataFrame, dispatching: DataFrame) -> DataFrame:
    """Calls that a report lists: of callees with an effect or that reach an open dispatch (fn)."""
    kept = functions.filter("mask <> 0").select(F.col("fn").alias("callee")).union(dispatching.select("fn")).distinct()
    return edges.join(kept, "callee", "left_semi").select("caller", "callee")


def fs_kinds(edges: DataFrame, direct: DataFrame) -> DataFrame:
    """fn, kinds (array): the kinds of file access that a function performs or reaches; none where an unknown kind is
    among them. direct: fn, value (read, write, or UNKNOWN_KIND)."""
    sets = value_fixpoint(edges, direct).groupBy("fn").agg(F.array_sort(F.collect_set("value")).alias("kinds"))
    return sets.filter(~F.array_contains("kinds", UNKNOWN_KIND))


def show_kinds(shown: DataFrame, kinds: DataFrame) -> DataFrame:
    """Rows of verbs.show with the kinds behind Fs, as Fs(read,write)."""
    with_kinds = shown.join(kinds, "fn", "left")
    told = F.concat(F.lit("Fs("), F.array_join("kinds", ","), F.lit(")"))
    return with_kinds.withColumn("inferred", F.when(F.col("kinds").isNotNull(), F.regexp_replace("inferred", r"\bFs\b", told)).otherwise(F.col("inferred"))).drop("kinds")


def merge_unions(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """key, mask, union_mask, synthetic: real rows with the union row of the same key beside them (union_mask), and union
    rows of members that no real row has (synthetic). real, synthetic: key, mask."""
    a = real.groupBy("key").agg(F.bit_or("mask").alias("a"))
    b = synthetic.groupBy("key").agg(F.bit_or("mask").alias("b"))
    both = a.join(b, "key", "full_outer")
    return both.select("key", F.coalesce("a", "b").alias("mask"), F.when(F.col("a").isNotNull(), F.col("b")).alias("union_mask"), F.col("a").isNull().alias("synthetic"))


def beside_unions(edges: DataFrame, both: DataFrame) -> DataFrame:
    """Calls, and for each of a callee that has a union row beside its real one a call of that row, named key#union."""
    twice = both.filter("union_mask is not null").select(F.col("key").alias("callee"))
    return edges.select("caller", "callee").unionByName(edges.join(twice, "callee", "left_semi").select("caller", F.concat("callee", F.lit("#union")).alias("callee")))


def contributors(supers: DataFrame, methods: DataFrame, reasons: DataFrame) -> DataFrame:
    """fn, classes: the reason classes that implementors (owner.method) of a member bring to its union row."""
    closure = reach(supers.select(F.col("type").alias("src"), F.col("super").alias("dst")), supers.select(*start("type")).distinct()).filter("hops > 0")
    rows = methods.join(closure.select(F.col("source").alias("owner"), F.col("node").alias("of")), "owner").select(F.concat_ws(".", "of", "method").alias("fn"), F.concat_ws(".", "owner", "method").alias("by"))
    return rows.join(reasons.select(F.col("fn").alias("by"), "why"), "by").groupBy("fn").agg(F.array_join(F.array_sort(F.collect_set(N.reason_class(F.col("why")))), ",").alias("classes"))


def override_counts(supers: DataFrame, members: DataFrame) -> DataFrame:
    """owner, method, n: how many self-or-subtypes of each type declare a member; members: owner, method."""
    types = supers.select("type").union(supers.select("super")).union(members.select("owner")).distinct().toDF("type")
    below = reach(supers.select(F.col("super").alias("src"), F.col("type").alias("dst")), types.select(*start("type")))
    rows = members.select("owner", "method").distinct().join(below.select(F.col("source").alias("of"), F.col("node").alias("owner")), "owner")
    return rows.groupBy(F.col("of").alias("owner"), "method").agg(F.countDistinct("owner").alias("n"))


def closed_types(types: DataFrame, permits: DataFrame) -> DataFrame:
    """type, closed, unseen: of each enum and sealed type, whether all its subtypes are known, and whether one of those it
    permits, over any number of steps, isn't visible.

    types (visible ones): type, enum, final; permits: type, permitted. A sealed type is closed if every permitted type
    is visible and each that permits none is final; an enum is closed.
    """
    sealed = permits.select("type").distinct().join(types.select("type"), "type", "left_semi")
    below = reach(permits.select(F.col("type").alias("src"), F.col("permitted").alias("dst")), sealed.select(*start("type")))
    known = types.select(F.col("type").alias("node"), F.col("final"), F.lit(True).alias("seen"))
    leaf = permits.select(F.col("type").alias("node")).distinct().withColumn("inner", F.lit(True))
    rows = below.join(known, "node", "left").join(leaf, "node", "left")
    bad = rows.groupBy(F.col("source").alias("type")).agg(F.max(F.col("seen").isNull()).alias("unseen"), F.max(F.col("seen").isNull() | (F.col("inner").isNull() & ~F.coalesce("final", F.lit(False)))).alias("open"))
    out = types.join(bad, "type", "left").filter(F.col("enum") | F.col("open").isNotNull())
    return out.select("type", (F.col("enum") | ~F.coalesce("open", F.lit(True))).alias("closed"), F.coalesce("unseen", F.lit(False)).alias("unseen"))


def entities(supers: DataFrame, markers: DataFrame, parameters: DataFrame) -> DataFrame:
    """type, entity: the entity of each repository: of a type that a marker (type) is above, the parameter (type, entity)
    of itself or else of the nearest type above it."""
    below = reach(supers.select(F.col("super").alias("src"), F.col("type").alias("dst")), markers.select(F.lit("").alias("source"), F.col("type").alias("node"), F.lit(0).alias("hops")).distinct())
    repositories = below.filter("hops > 0").select(F.col("node").alias("type"))
    above = reach(supers.select(F.col("type").alias("src"), F.col("super").alias("dst")), repositories.select(*start("type")).distinct())
    rows = above.join(parameters.select(F.col("type").alias("node"), "entity"), "node")
    return rows.groupBy(F.col("source").alias("type")).agg(F.min(F.struct("hops", "node", "entity")).alias("m")).select("type", "m.entity")


def merge_deltas(deltas: DataFrame, sets: list[str], sums: list[str]) -> DataFrame:
    """One row a key from delta rows: arrays united and sorted, numbers added up. Items are told apart before they meet, so
    what a key's repeats hold in common is one item a task and not one a row."""
    out = deltas.groupBy("key").agg(F.count("*").alias("_n"), *[F.sum(c).alias(c) for c in sums]).drop("_n")
    for c in sets:
        items = deltas.select(F.col("key").alias("_k"), F.explode(c).alias("_item")).distinct().groupBy("_k").agg(F.array_sort(F.collect_list("_item")).alias(c))
        out = out.join(items, F.col("key").eqNullSafe(F.col("_k")), "left").drop("_k").withColumn(c, F.coalesce(c, F.array().cast(deltas.schema[c].dataType)))
    return out.select("key", *sets, *sums)


def top_unknown(reasons: DataFrame, most: int = 12) -> DataFrame:
    """tag, n: the commonest reasons for Unknown in full, ties by tag."""
    return reasons.groupBy(F.col("why").alias("tag")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(most)


def unknown_share(functions: DataFrame) -> DataFrame:
    """n_unknown, n_effectful, mostly: how many functions with effects are Unknown, and whether a third or more are."""
    out = functions.filter("mask <> 0").agg(F.count(F.when(F.col("mask").bitwiseAND(BIT["Unknown"]) != 0, 1)).alias("n_unknown"), F.count("*").alias("n_effectful"))
    return out.withColumn("mostly", (F.col("n_effectful") > 0) & (3 * F.col("n_unknown") >= F.col("n_effectful")))


def surprise(best: DataFrame, functions: DataFrame) -> DataFrame:
    """state, fn, effect, hops, found: winner with the most surprising reach (best: rows of verbs.tour), fallback where
    there are effects but none surprises, none without effects."""
    first = best.orderBy(F.desc("score"), "hops", "fn").limit(1).select(F.lit("winner").alias("state"), "fn", "effect", "hops", "found", F.lit(0).alias("k"))
    some = functions.filter("mask <> 0").limit(1).select(F.lit("fallback").alias("state"), F.lit(1).alias("k"))
    none = functions.sparkSession.createDataFrame([("none", 2)], "state string, k int")
    rows = first.unionByName(some, allowMissingColumns=True).unionByName(none, allowMissingColumns=True)
    return rows.orderBy("k").limit(1).drop("k")


def universe(nodes: DataFrame, uncovered: DataFrame) -> DataFrame:
    """fn of the functions that a run can be held against: all but those of packages that weren't covered (package)."""
    rows = nodes.withColumn("_package", N.module_of(N.declaring_type(F.col("fn"))))
    return rows.join(uncovered.select(F.col("package").alias("_package")).distinct(), "_package", "left_anti").select("fn")


def gate_input(rows: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units (key, name, mask, reasons, synthetic) and calls (caller, callee: keys) of report rows.

    rows: fn, hash, package, mask, direct_unknown, reasons (array of tags), interface_union; calls: hash, fn, name. A unit
    is told by its hash, or its name without one. A union row beside a real one of the same key is a unit of its own. A
    called name that several units have leaves no call, and the caller may do anything by dispatch.
    """
    from emberflow.operators.verbs import resolve_calls

    key = F.when(F.col("hash") != "", F.col("hash")).otherwise(F.col("fn"))
    units = rows.withColumn("_key", key)
    beside = Window.partitionBy("_key")
    both = F.col("interface_union") & (F.max((~F.col("interface_union")).cast("int")).over(beside) == 1)
    units = units.withColumn("key", F.when(both, F.concat("_key", F.lit("#union"))).otherwise(F.col("_key")))
    named = calls.withColumn("caller", key).join(units.filter(~F.col("interface_union") | (F.col("key") == F.col("_key"))).select(F.col("key").alias("caller"), "package").distinct(), "caller").select("caller", "package", "name")
    made = resolve_calls(named, units.filter(~F.endswith("key", F.lit("#union"))).select(F.col("fn").alias("name"), "package", F.col("key")).distinct())
    edges = made.filter("key is not null").select("caller", F.col("key").alias("callee")).distinct()
    twice = units.filter(F.endswith("key", F.lit("#union"))).select(F.col("_key").alias("callee"), F.col("key").alias("u")).distinct()
    edges = edges.unionByName(edges.join(twice, "callee").select("caller", F.col("u").alias("callee")))
    lost = made.filter("ambiguous").select(F.col("caller").alias("key")).distinct().withColumn("lost", F.lit(True))
    own = F.transform("reasons", N.reason_class)
    own = F.when(F.col("direct_unknown") & (F.size("reasons") == 0), F.array(F.lit("unresolved"))).otherwise(own)
    out = units.withColumn("_own", own).groupBy("key").agg(F.min("fn").alias("name"), F.bit_or("mask").alias("mask"), F.array_distinct(F.flatten(F.collect_list("_own"))).alias("reasons"), F.every("interface_union").alias("synthetic"))
    out = out.join(lost, "key", "left").withColumn("mask", F.when(F.col("lost"), F.col("mask").bitwiseOR(BIT["Unknown"])).otherwise(F.col("mask")))
    reasons = F.array_sort(F.when(F.col("lost"), F.array_union("reasons", F.array(F.lit("dispatch")))).otherwise(F.col("reasons")))
    return out.select("key", "name", "mask", reasons.alias("reasons"), "synthetic"), edges
