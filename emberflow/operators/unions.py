"""Rows of a report that stand for members without a body: the union of what the bodies behind them do.

A member has such a row by one of three arms: own, a member of an interface of this package or an abstract one of a class;
foreign, a member that a class of this package has a body for and that a type of another package above it may declare;
lambda, a member of another package's interface that a lambda here stands for. Foreign types of packages that are modelled
(so known without a report) or of no package have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberflow.functions.effects import BIT
from emberflow.operators.dispatch import ROOT
from emberflow.operators.fixpoint import reach
from emberflow.plans.runtime import stored

ARMS = ("own", "foreign", "lambda")
# Members that every object has, which count as pure.
EVERYWHERE = ("equals", "finalize", "hashCode", "toString")


def package(type_: Column) -> Column:
    return F.regexp_extract(type_, r"^(.*)\.[^.]*$", 1)


def candidates(types: DataFrame, methods: DataFrame, above: DataFrame, lambdas: DataFrame, modelled: DataFrame) -> DataFrame:
    """owner, method, arms (bits in order of ARMS): the members that have a union row.

    types: type, interface, of this package; methods: owner, method, abstract; above: type, of (transitive supertypes);
    lambdas: owner, method; modelled: package, which covers packages below it too.
    """
    members = methods.filter(~F.startswith("method", F.lit("<"))).join(types.select(F.col("type").alias("owner"), "interface"), "owner")
    own = members.filter("interface or abstract").select("owner", "method", F.lit(1).alias("arms"))
    away = above.select("of").union(lambdas.select("owner")).distinct().join(types.select(F.col("type").alias("of")), "of", "left_anti").filter(~F.col("of").isin(*ROOT))
    # A package is covered by any beginning of its own name, up to a dot: an equi-join on all of them.
    names = away.withColumn("p", package(F.col("of"))).filter("p <> ''")
    heads = names.withColumn("s", F.split("p", r"\.")).select("of", F.explode(F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.array_join(F.slice("s", F.lit(1), i), "."))).alias("package"))
    open_ = stored(names.select("of").join(heads.join(modelled, "package", "left_semi").select("of"), "of", "left_anti").distinct())
    bodies = members.filter("not abstract").filter(~F.col("method").isin(*EVERYWHERE))
    foreign = bodies.join(above.withColumnRenamed("type", "owner"), "owner").join(open_, "of", "left_semi").select(F.col("of").alias("owner"), "method", F.lit(2).alias("arms"))
    made = lambdas.join(open_.withColumnRenamed("of", "owner"), "owner", "left_semi").filter(~F.col("method").isin(*EVERYWHERE)).select("owner", "method", F.lit(4).alias("arms"))
    return own.unionByName(foreign).unionByName(made).groupBy("owner", "method").agg(F.bit_or("arms").alias("arms"))


def union_rows(types: DataFrame, supers: DataFrame, methods: DataFrame, lambdas: DataFrame, modelled: DataFrame, closed: DataFrame, most: int = 12) -> DataFrame:
    """fn, arms, mask, n_bodies, n_lambdas, why, real: the union row of each member that has one.

    methods: owner, method, abstract, mask; lambdas: owner, method, fn, mask; closed: type of owners whose subtypes are all
    in sight. More than `most` bodies of an owner that isn't closed are Unknown in place of their union; lambdas that carry
    the number beyond it are left out and Unknown is added. A member that nothing stands behind has no row; one whose
    bodies are all pure has mask 0. real: the member has a body of its own, so the row widens that body's.
    """
    above = stored(reach(supers.select(F.col("type").alias("src"), F.col("super").alias("dst")), types.select(F.col("type").alias("source"), F.col("type").alias("node"), F.lit(0).alias("hops"))).filter("hops > 0").select(F.col("source").alias("type"), F.col("node").alias("of")))
    wanted = stored(candidates(types, methods, above, lambdas, modelled))
    bodies = methods.filter("not abstract").join(types.select(F.col("type").alias("owner")), "owner", "left_semi")
    behind = bodies.select(F.col("owner").alias("of"), "owner", "method", "mask").unionByName(bodies.join(above.withColumnRenamed("type", "owner"), "owner").select("of", "owner", "method", "mask"))
    # All that stands behind a member in one aggregate, whatever it comes from.
    rows = behind.select(F.col("of").alias("owner"), "method", "mask", F.lit(False).alias("lambda"), F.col("of") == F.col("owner")).toDF("owner", "method", "mask", "lambda", "self")
    rows = rows.unionByName(lambdas.select("owner", "method", "mask", F.lit(True).alias("lambda"), F.lit(False).alias("self")))
    bits = lambda cond: F.coalesce(F.bit_or(F.when(cond, F.col("mask"))), F.lit(0))
    count = lambda cond: F.count(F.when(cond, 1))
    summed = rows.groupBy("owner", "method").agg(bits(~F.col("lambda")).alias("m"), bits(F.col("lambda")).alias("l"), count(~F.col("lambda")).alias("n_bodies"), count(F.col("lambda")).alias("n_lambdas"), F.max("self").alias("real"))
    out = summed.join(wanted, ["owner", "method"]).join(closed.select(F.col("type").alias("owner"), F.lit(True).alias("_closed")).distinct(), "owner", "left")
    open_ = F.col("_closed").isNull()
    wide = open_ & (F.col("n_bodies") > most)
    wider = open_ & (F.col("n_lambdas") > 0) & (F.col("n_bodies") + F.col("n_lambdas") > most)
    unknown = F.lit(BIT["Unknown"])
    mask = F.when(wide, unknown).when(wider, F.col("m").bitwiseOR(unknown)).otherwise(F.col("m").bitwiseOR(F.col("l")))
    arms = F.array_compact(F.array(*[F.when(F.col("arms").bitwiseAND(1 << i) != 0, F.lit(a)) for i, a in enumerate(ARMS)]))
    fn = F.concat_ws(".", "owner", "method")
    return out.select(fn.alias("fn"), F.array_join(arms, ",").alias("arms"), mask.alias("mask"), "n_bodies", "n_lambdas", F.when(wide | wider, F.concat(F.lit("dispatch:"), fn)).alias("why"), "real")
