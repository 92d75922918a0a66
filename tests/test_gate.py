"""Gates over reports, accept lines kept up to date, rules in canonical form."""

import json

import pytest
from pyspark.sql import functions as F

from emberflow.functions import calls as K
from emberflow.functions import names as N
from emberflow.functions.effects import BIT, mask_of
from emberflow.operators import gate as G
from emberflow.operators import policy as P
from emberflow.operators import rows as R
from emberflow.operators import verbs as V


def rows(spark, data):
    """fn, mask, reasons, destinations, interface_union."""
    return spark.createDataFrame([(f, mask_of(e), r, d, u) for f, e, r, d, u in data], "fn string, mask int, reasons array<string>, destinations array<string>, interface_union boolean")


def test_verdict_goes_violation_then_unevaluated_then_incomplete(spark):
    f = rows(spark, [("app.api.A.run", ["Net"], [], ["unknown-host"], False), ("app.dao.B.go", ["Unknown"], [], [], False), ("app.api.I.run", ["Net"], [], ["unknown-host"], True)])
    exit_ = lambda policy, reports=None: G.gate(f, P.parse(policy), reports)["verdict"].first()["exit"]
    assert exit_("deny Net api\nforbid api -> dao") == 1
    assert exit_("deny Db api\nforbid api -> dao") == 2 and exit_("deny Db api") == 0
    assert exit_("deny Unknown[reflect] dao") == 2, "no evidence of a class withholds the rule"
    assert exit_("deny Net api\naccept app.api.A.run Net for deny Net api because x") == 0
    assert exit_("deny Db api\naccept app.api.A.run Db for deny Db api because x") == 1, "a stale line is a violation"
    reports = spark.createDataFrame([([("a", "torn")], None, None)], "unanalyzed array<struct<path:string,reason:string>>, out_of_scope array<struct<fn:string>>, excluded array<struct<peeked:boolean>>")
    assert exit_("deny Db api", reports) == 2
    assert [r["fn"] for r in P.denied(f, P.parse("deny Net api")).collect()] == ["app.api.A.run"], "synthetic rows aren't judged"


def test_accept_lines_of_rules_that_cant_be_judged_are_no_fault(spark):
    """Unjudged or ambiguous lines aren't stale: nothing is accepted by them, and the exit code is that of what is open."""
    f = rows(spark, [("app.api.A.run", ["Net"], [], [], False), ("app.api.U.run", ["Db"], [], [], True)])
    verdict = lambda policy, same=None: G.gate(f, P.parse(policy), None, same)["verdict"].first().asDict()
    v = verdict("deny Fs api\nforbid api -> db\naccept app.api.A Db for forbid api -> db because y")
    assert (v["n_stale"], v["n_unjudged"], v["exit"], v["refused"]) == (0, 1, 2, True)
    v = verdict("deny Net[unknown-host] api\naccept app.api.A.run Net for deny Net[unknown-host] api because y")
    assert (v["n_violations"], v["n_stale"], v["n_unjudged"], v["exit"]) == (0, 0, 1, 2)
    twins = spark.createDataFrame([("app.api.A.run",)], "fn string")
    v = verdict("deny Net api\naccept app.api.A.run Net for deny Net api because y", twins)
    assert (v["n_violations"], v["n_stale"], v["n_ambiguous"], v["exit"]) == (1, 0, 1, 1)
    assert verdict("deny Db api")["exit"] == 0, "a union row isn't judged"
    # A function that is open alone withholds the claim of an answer.
    answer = spark.createDataFrame([(True,)], "ok boolean")
    open_ = G.gate(f, P.parse("deny Net[unknown-host] api"))["verdict"]
    assert G.advisory(answer, open_).first()["ok"] is None and G.advisory(answer, G.gate(f, P.parse("deny Db api"))["verdict"]).first()["ok"]
    assert {r["part"] for r in G.document(G.gate(f, P.parse("deny Net api\nforbid a -> b"))).collect()} == {"verdict", "violations", "unevaluated"}


@pytest.mark.parametrize(
    "line, reasons, destinations",
    [
        ("deny Net Net[known-partner] api", (), ()),
        ("deny Net[known-partner] Net api", (), ()),
        ("deny Unknown[dispatch] Unknown[reflect] api", ("dispatch", "reflect"), ()),
        ("deny Unknown[*] api", (), ()),
        ("deny Net[*] api", (), ()),
        ("deny Net[known-partner,*] api", (), ()),
        ("deny Net[known-partner,,unknown-host,] api", (), ("known-partner", "unknown-host")),
        ("deny Net[] Unknown[ours] api", ("native", "setup"), ()),
    ],
)
def test_narrowed_effects_unite_and_a_bare_one_is_all(line, reasons, destinations):
    (r,) = P.parse(line, {"ours": ("native", "setup")})
    assert (r.reasons, r.destinations, r.scope) == (reasons, destinations, "api") and len(set(r.effects)) == len(r.effects)


@pytest.mark.parametrize("line", ["deny Net[nowhere] x", "deny Unknown[refl] x", "deny Fs[read] x", "deny Net[known-partner,typo] x"])
def test_bad_classes_refuse_the_policy(line):
    with pytest.raises(P.PolicyError):
        P.parse(line)


def test_null_literals_certify_nothing(spark):
    f = rows(spark, [("a.b", ["Net"], [], [], False)])
    lits = spark.createDataFrame([("a.b", "Net", None)], "fn string, effect string, value string")
    assert [tuple(r)[2:] for r in P.outside_allowlist(f, lits, P.parse("allow Net x.com")).collect()] == [("a.b", "Net", "")]


def test_policies_without_rules_of_a_kind_give_no_rows(spark):
    f, e = rows(spark, [("a.b", ["Net"], [], [], False)]), spark.createDataFrame([("a.b", "a.c")], "caller string, callee string")
    lits = spark.createDataFrame([], "fn string, effect string, value string")
    deny = P.parse("deny Net")
    assert P.outside_allowlist(f, lits, deny).count() == P.forbidden(f, e, deny).count() == P.unpermitted(f, e, deny).count() == 0
    assert P.denied(f, P.parse("forbid a -> b")).count() == 0 and G.unanswerable(f, deny).count() == 0


def test_canonical_rules():
    deny, pure, narrow = P.parse("deny Net Db x\npure y\ndeny Unknown[unresolved,dispatch] Net[unknown-host] z")
    assert G.canonical_set([deny, pure, narrow]) == sorted(["deny Db Net x", "pure y", "deny Net[unknown-host] Unknown[dispatch,unresolved] z"])
    assert G.upgrade(pure) == "deny Unknown y" and G.upgrade(narrow, {"native"}) == "deny Net[unknown-host] Unknown[dispatch,native,unresolved] z"
    assert G.narrowing(deny, "Net") is None and "unknown-host" in G.narrowing(narrow, "Net")
    assert json.loads(G.policy_json([pure]))["deny"] == [{"effects": [], "scope": "y"}]


@pytest.mark.parametrize("wide, narrow, covers", [("", "a", True), ("a", "", False), ("a", "x.ab", True), ("a.", "x.ab", False), ("a.b", "a.bc.d", True), ("a.b", "a.x.b", False)])
def test_scope_covers(wide, narrow, covers):
    assert G.scope_covers(wide, narrow) == covers


def test_reason_filter():
    assert N.reason_filter("*") is None and N.reason_filter("reflect, native") == ("reflect", "native")
    assert "setup" not in N.reason_filter("dynamic")
    with pytest.raises(ValueError):
        N.reason_filter("refl")


def test_remedies_of_names_with_commas(spark):
    site, caller, top = "app.dao.T.get(int,long)", "app.dao.T.all(int)", "app.api.C.show(java.util.Map,int)"
    e = spark.createDataFrame([(caller, site), (top, caller)], "caller string, callee string")
    f = spark.createDataFrame([(x, BIT["Db"], BIT["Db"] if x == site else 0) for x in (site, caller, top)], "fn string, mask int, direct_mask int")
    (r,) = V.remedies(f, e, "Db", F.col("fn").contains(".dao.")).collect()
    assert tuple(r) == ([site], 2, 2, [top], 0, True)


def test_baselines_with_repeated_names_count_the_last_row(spark):
    now = spark.createDataFrame([("a", mask_of(["Net", "Fs"]))], "fn string, mask int")
    base = spark.createDataFrame([("a", mask_of(["Net"]), 1), ("a", mask_of(["Fs"]), 2)], "fn string, mask int, place int")
    assert [r["gained"] for r in V.baseline_guard(now, base).collect()] == ["Net"]
    assert V.baseline_guard(now, base.drop("place")).count() == 0


def test_origins_of_gains(spark):
    frame = lambda fns: spark.createDataFrame([(f, BIT["Net"], 0) for f in fns], "fn string, mask int, direct_mask int")
    nodes = spark.createDataFrame([("b",)], "fn string")
    origin = lambda *a: {r["fn"]: r["origin"] for r in V.gains(frame(["a", "b", "c"]), frame(["a"]), *a).collect()}
    assert origin() == {"b": "unknown", "c": "unknown"}
    assert origin(nodes) == {"b": "existing", "c": "new"} and origin(nodes, True) == {"b": "existing", "c": "unknown"}


def test_lambdas_are_settled_outwards_only_as_far_as_their_effects_are_accepted(spark):
    v = spark.createDataFrame([("p.C.run", "r", ["Db", "Net"]), ("p.C.lambda$run$0", "r", ["Net"]), ("p.C.lambda$lambda$run$0$1", "r", ["Db"]), ("p.C.lambda$static$2", "r", ["Net"]), ("p.C.other", "r", ["Fs"])], "fn string, rule string, effects array<string>")
    accepts = spark.createDataFrame([("p.C.run", "r", ["Db", "Net"]), ("p.C.other", "r", ["Net"])], "fn string, rule string, effects array<string>")
    edges = spark.createDataFrame([("p.C.lambda$run$0", "p.C.lambda$lambda$run$0$1")], "caller string, callee string")
    got = {r["fn"]: r["accepted_by"] for r in G.settle(v, accepts, edges).collect()}
    assert got == {"p.C.run": "p.C.run", "p.C.lambda$run$0": "p.C.run", "p.C.lambda$lambda$run$0$1": "p.C.run", "p.C.lambda$static$2": None, "p.C.other": None}
    twin = spark.createDataFrame([("p.C.run",)], "fn string")
    assert {r["accepted_by"] for r in G.settle(v, accepts, edges, twin).collect()} == {None}


def test_surprise_states(spark):
    best = spark.createDataFrame([("a", "Net", 2, "b", 30)], "fn string, effect string, hops long, found string, score long")
    f = spark.createDataFrame([("a", 1)], "fn string, mask int")
    state = lambda b, g: R.surprise(b, g).first()["state"]
    assert state(best, f) == "winner" and state(best.limit(0), f) == "fallback" and state(best.limit(0), f.filter("mask = 0")) == "none"


def test_gate_units_of_ambiguous_calls(spark):
    no = ([], False)
    data = [("x.run", "h1", "p", BIT["Net"], False, [], False), ("x.run", "h2", "q", 0, False, [], False), ("c.go", "h3", "r", 0, True, [], False), ("i.do", "h4", "p", 0, False, ["reflect:a"], False), ("i.do", "h4", "p", BIT["Db"], False, [], True)]
    rows_ = spark.createDataFrame(data, "fn string, hash string, package string, mask int, direct_unknown boolean, reasons array<string>, interface_union boolean")
    calls = spark.createDataFrame([("h3", "c.go", "x.run"), ("h1", "x.run", "i.do"), ("h3", "c.go", "gone.away")], "hash string, fn string, name string")
    units, edges = R.gate_input(rows_, calls)
    u = {r["key"]: r for r in units.collect()}
    assert u["h3"]["mask"] == BIT["Unknown"] and u["h3"]["reasons"] == ["dispatch", "unresolved"]
    assert u["h4"]["reasons"] == ["reflect"] and not u["h4"]["synthetic"] and u["h4#union"]["synthetic"] and u["h4#union"]["mask"] == BIT["Db"]
    assert {tuple(r) for r in edges.collect()} == {("h3", "gone.away"), ("h1", "h4"), ("h1", "h4#union")}
    assert no


def test_library_rules_are_told_apart():
    rules = K.rules()
    assert len(rules) == len({r[1:] for r in rules}) and [r[0] for r in rules] == list(range(len(rules)))


def test_calls_meet_rules_of_their_own_ancestors(spark):
    rules = spark.createDataFrame(K.rules(), "priority int, owner string, method_pattern string, effect string, descriptor string")
    calls = [("java.io.File", "exists", "()Z", "Fs"), ("java.io.FileFilter", "exists", "()Z", None), ("java.net.Socket$Inner", "x", "()V", "Net"), ("org.slf4j.a.b.Logger", "info", "()V", "Log"), ("java.util.Random", "nextInt", "()I", "Rand"), ("java.util.RandomAccess", "nextInt", "()I", None), ("java.util.Collections", "shuffle", "(Ljava/util/List;)V", "Rand"), ("java.util.Collections", "shuffle", "(Ljava/util/List;Ljava/util/Random;)V", None), ("software.amazon.awssdk.services.bedrockruntime.C", "x", "", "Llm"), ("software.amazon.awssdk.services.s3.C", "x", "", "Net"), ("", "x", "", None)]
    got = V.classify_calls(spark.createDataFrame(calls, "owner string, method string, descriptor string, want string"), rules).collect()
    assert {tuple(r) for r in got} == {c for c in calls if c[3]}
