"""Chained reports, open dispatch and small ledgers."""

import pytest
from pyspark.sql import functions as F

from emberflow.functions.effects import BIT, mask_of, names_of
from emberflow.operators import chaining as C
from emberflow.operators import verbs as V


def test_stale_dependencies_say_unknown(spark):
    rows = spark.createDataFrame([("h1", "1", BIT["Net"], None), ("h2", "0", BIT["Net"], None), ("h3", "1", BIT["Unknown"], None)], "hash string, version string, mask int, why string")
    got = {r["hash"]: (r["n"], r["reason"]) for r in C.dependency_functions(rows, "1").select("hash", names_of(F.col("mask")).alias("n"), "reason").collect()}
    assert got == {"h1": (["Net"], None), "h2": (["Unknown"], "dep-stale:h2"), "h3": (["Unknown"], "dep:h3")}


def test_dispatch_frontier(spark):
    f = lambda rows, s: spark.createDataFrame(rows, s)
    reasons = f([("app.Frontier.go", "dispatch:app.Base.run"), ("app.Other.go", "dispatch:app.Far.run"), ("app.Open.go", "dispatch:app.Lost.run"), ("app.Bare.go", "dispatch:run"), ("app.Quiet.idle", "reflect:run")], "fn string, why string")
    supers = f([("app.Impl", "app.Base"), ("app.Impl2", "app.Gone")], "type string, super string")
    indexed = f([("app.Impl",), ("app.Base",), ("app.Far",)], "type string")
    got = lambda *b: sorted(r["fn"] for r in C.dispatch_frontier(reasons, f([(x,) for x in b], "fn string"), supers, indexed).collect())
    assert got("app.Impl.run") == ["app.Bare.go", "app.Frontier.go"]
    assert got("app.Impl2.run") == ["app.Bare.go", "app.Frontier.go", "app.Open.go", "app.Other.go"]


@pytest.mark.parametrize(
    "sql, want",
    [("SELECT * FROM a.b x JOIN `c` ON 1", ["a.b", "c"]), ("insert into log(a) values (1)", ["log"]), ("update only t set x = 1 for update skip locked", ["t"]), ("create table if not exists s.t (a int)", ["s.t"]), ("take it from me", []), ("select f(x) from gen(3)", ["gen"]), ("select 1 from a, b, c d, e", ["a", "b", "c"]), ("insert into t (a, b) select 1", ["t"]), ("truncate table x, y", ["x", "y"]), ("merge into a\n\tusing b", ["a"]), ("select 1 from 9x, y", []), ("update", []), ("", []), ("select 1 from a, table b", ["a", "b", "table"])],
)
def test_tables_in_sql(spark, sql, want):
    assert spark.createDataFrame([(sql,)], "s string").select(C.tables_in_sql(F.col("s")).alias("t")).first()["t"] == want


def test_digest_ignores_order_and_repeats(spark):
    d = lambda x: tuple(C.digest(spark.createDataFrame([(y,) for y in x], "name string")).first())
    assert d("abc") == d("cabba") and d("abc") != d("abd")


def test_dispatch_by_hierarchy(spark):
    f = lambda rows, s: spark.createDataFrame(rows, s)
    supers = f([("B", "A"), ("C", "A")] + [(f"W{i}", "Wide") for i in range(13)], "type string, super string")
    methods = f([("A", "m"), ("B", "m"), ("A", "up")] + [(f"W{i}", "m") for i in range(13)], "owner string, method string")
    sites = f([("s1", "A", "m"), ("s2", "C", "up"), ("s3", "Wide", "m"), ("s4", "C", "none")], "site string, owner string, method string")
    assert sorted(map(tuple, V.dispatch_targets(sites, supers, methods).collect())) == [("s1", "A.m"), ("s1", "B.m"), ("s2", "A.up")]
    masks = methods.withColumn("mask", F.when(F.col("owner") == "B", mask_of(["Net"])).otherwise(mask_of(["Fs"])))
    rows = {r["fn"]: (r["n"], r["n_implementors"]) for r in V.union_rows(supers, masks).select("fn", names_of(F.col("mask")).alias("n"), "n_implementors").collect()}
    assert rows["A.m"] == (["Net"], 1) and rows["Wide.m"] == (["Fs"], 13)
