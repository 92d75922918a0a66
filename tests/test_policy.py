"""Policy lines, scopes and literals."""

import pytest
from pyspark.sql import functions as F

from emberflow.functions import names as N
from emberflow.functions.effects import BIT, mask_of
from emberflow.operators import policy as P


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "s string").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("text", ["", "deny Nope domain", "deny Unknown[what] api", "allow Log x", "forbid a b", "deny Net[somewhere] x", "accept a Net for deny Net x because y"])
def test_bad_policies_are_refused(text):
    with pytest.raises(P.PolicyError):
        P.parse(text)


def test_lines():
    r = P.parse("deny Net Db Fs domain # why\ndeny Unknown[dynamic] api\nallow Db in billing ledger.*\nonly model -> util io\naccept app.A.run Net for deny Net Db Fs domain because reviewed")
    assert [x.kind for x in r] == ["deny", "deny", "allow", "only", "accept"]
    assert r[0].effects == ("Net", "Db", "Fs") and r[0].scope == "domain" and "setup" not in r[1].reasons
    assert r[2].values == ("ledger.*",) and r[3].to == ("util", "io") and r[4].rule == r[0].text


@pytest.mark.parametrize(
    "name, scope, want",
    [("a.app.B.run", "app", True), ("a.application.B", "app", True), ("a.application.B", "app.", False), ("a.b", "", True), ("x.dom.A.m", "dom.A", True), ("x.dom.Ab.m", "dom.A", True), ("x.domx.A.m", "dom.A", False), ("x.A.m(a.dom.B)", "dom", False)],
)
def test_scopes(spark, name, scope, want):
    assert one(spark, N.scope_matches(N.segments(F.col("s")), scope), name) is want


def test_permitted_scopes_are_whole_segments(spark):
    assert one(spark, N.scope_permits(N.segments(F.col("s")), "util"), "a.util.B")
    assert not one(spark, N.scope_permits(N.segments(F.col("s")), "util"), "a.utils.B")
    assert not one(spark, N.scope_permits(N.segments(F.col("s")), ""), "a.utils.B")


@pytest.mark.parametrize("text, want", [("https://u@api.x.com:8/p", "api.x.com:8"), ("db.x:5432", "db.x:5432"), ("db:5432", None), ("10.0.0.1", "10.0.0.1"), ("10.0.0.256", None), ("word", None), (" ", None), ("a b", None)])
def test_host_literals(spark, text, want):
    assert one(spark, N.host_literal(F.col("s")), text) == want


@pytest.mark.parametrize("host, want", [("localhost:11434", True), ("far:11434", False), ("eu.api.openai.com:443", True), ("bedrock-runtime.eu.amazonaws.com", True), ("bedrock.eu.amazonaws.com", False), ("notapi.openai.com.evil", False)])
def test_model_hosts(spark, host, want):
    assert one(spark, N.is_model_host(F.col("s")), host) is want


def test_cover(spark):
    c = lambda f, a, r: one(spark, f(F.lit(a), F.lit(r)))
    assert c(N.path_covered, "/etc/app", "/etc/app/cfg") and not c(N.path_covered, "/etc/app", "/etc/apppwned")
    assert not c(N.path_covered, "/etc", "/etc/../x") and not c(N.path_covered, "etc", "/etc/x")
    assert c(N.table_covered, "ledger.*", "LEDGER.x") and not c(N.table_covered, "entries", "ledger.entries")
    assert one(spark, N.host_part(F.lit("[::1]:80"))) == "::1" and one(spark, N.host_part(F.lit("2001:db8::1"))) == "2001:db8::1"
    assert one(spark, N.command_base(F.lit("/usr/bin/curl -s x"))) == "curl"
    assert one(spark, N.command_effects(F.lit("psql -c x"))) == ["Db"]


@pytest.mark.parametrize("why, want", [("dispatch:x", "dispatch"), (" REFLECT:x", "reflect"), ("callback:x", "indirect"), ("dep:x", "unresolved"), (None, "unresolved"), ("missing-config", "setup")])
def test_reason_classes(spark, why, want):
    assert spark.createDataFrame([(why,)], "s string").select(N.reason_class(F.col("s")).alias("r")).first()["r"] == want


def test_tiers_and_tokens(spark):
    assert [one(spark, N.match_tier(F.col("s"), q), "a.B.run") for q in ("a.B.run", "run", "B", "", "zz")] == [3, 2, 1, 0, 0]
    assert one(spark, N.tokens(F.col("s")), "a_bcD.x2Y") == ["a", "bc", "d", "x2", "y"]
    assert one(spark, N.is_test(F.col("s")), "a.FooTests.x") and not one(spark, N.is_test(F.col("s")), "a.Foo.testIt")


def test_rules(spark):
    rules = P.parse("deny Net[unknown-host] dao\npure util\nallow Net in dao api.x.com\nforbid dao -> util\nonly dao -> util\naccept a.dao.A Net for deny Net[unknown-host] dao because x")
    rows = [("a.dao.A", mask_of(["Net"]), ["unresolved"], ["unknown-host"]), ("a.dao.B", mask_of(["Net"]), ["unresolved"], ["known-partner"]), ("a.util.C", BIT["Unknown"], [], [])]
    f = spark.createDataFrame(rows, "fn string, mask int, reasons array<string>, destinations array<string>")
    e = spark.createDataFrame([("a.dao.A", "a.util.C"), ("a.dao.B", "a.dao.A"), ("a.dao.B", "z.Other")], "caller string, callee string")
    v = P.denied(f, rules)
    assert [(r["rule"], r["fn"], r["effects"]) for r in v.collect()] == [("deny Net[unknown-host] dao", "a.dao.A", "Net")]
    lit = spark.createDataFrame([("a.dao.A", "Net", "api.x.com:443")], "fn string, effect string, value string")
    assert [(r["fn"], r["reached"]) for r in P.outside_allowlist(f, lit, rules).collect()] == [("a.dao.B", "")]
    assert sorted((r["fn"], r["reached"], r["hops"]) for r in P.forbidden(f, e, rules).collect()) == [("a.dao.A", "a.util.C", 1), ("a.dao.B", "a.util.C", 2)]
    more = f.union(spark.createDataFrame([("z.Other", 0, [], [])], f.schema))
    assert [(r["fn"], r["reached"]) for r in P.unpermitted(more, e, rules).collect()] == [("a.dao.B", "z.Other")]
    assert [r["status"] for r in P.judge_accepts(v, rules).collect()] == ["accepted"]
    assert P.verdict(1, 1) == 1 and P.verdict(0, 1) == 2 and P.verdict(0) == 0
