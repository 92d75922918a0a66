"""Registered queries over gates, report rows, reports on disk, notes and streams, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberflow.functions import calls as K
from emberflow.functions import names as N
from emberflow.functions.effects import BIT, names_of
from emberflow.operators import gate as G
from emberflow.operators import policy as P
from emberflow.operators import rows as R
from emberflow.operators import verbs as V
from emberflow.operators.fixpoint import effect_fixpoint, value_fixpoint
from emberflow.plans import queries as Q
from emberflow.plans.registry import query
from emberflow.plans.runtime import shared_dir
from emberflow.plans.views import Model, file_state
from emberflow.sources import dependencies as D
from emberflow.sources import envelope as E
from emberflow.sources import locate as L
from emberflow.sources import report as S
from emberflow.streaming import verify as T


def _told(mask: str = "mask"):
    return F.array_join(names_of(F.col(mask)), ",")


# ---------------------------------------------------------------- lists, selections, notes


@query("SELECT i.effect, CASE WHEN d.fn IS NULL THEN 'inherited' ELSE 'direct' END AS how, i.fn FROM inferred i LEFT JOIN direct d ON d.fn = i.fn AND d.effect = i.effect WHERE i.effect = 'Db'")
def where_list(m: Model) -> DataFrame:
    return V.where_list(m.functions(), "Db")


@query("SELECT i.effect, i.fn FROM inferred i JOIN entry_points e ON e.fn = i.fn")
def reachable_list(m: Model) -> DataFrame:
    return V.reachable_list(m.functions())


@query("+ hit AS (SELECT fn FROM nodes WHERE contains(fn, 'o.S1')) SELECT fn, (SELECT count(*) FROM hit) AS n FROM hit ORDER BY fn LIMIT 12")
def select_single(m: Model) -> DataFrame:
    # No name ends in .o.S1, so all that hold it as a part are at the best tier.
    return V.single(m.functions(), "o.S1")


@query("SELECT why AS tag, count(*) AS n FROM reasons GROUP BY why ORDER BY n DESC, tag LIMIT 12")
def top_unknown(m: Model) -> DataFrame:
    return R.top_unknown(m.reasons())


@query("+ s AS (SELECT count(DISTINCT fn) FILTER (effect = 'Unknown') AS u, count(DISTINCT fn) AS n FROM inferred) SELECT u AS n_unknown, n AS n_effectful, n > 0 AND 3 * u >= n AS mostly FROM s")
def unknown_share(m: Model) -> DataFrame:
    return R.unknown_share(m.functions())


@query(Q._tour_sql(("Db", "Net", "Fs")).replace(" FROM best WHERE k = 1 ORDER BY score DESC, hops, fn LIMIT 10", " FROM best WHERE k = 1 ORDER BY score DESC, hops, fn LIMIT 1").replace("SELECT fn, effect, CAST(hops AS BIGINT) AS hops, found, CAST(score AS BIGINT) AS score FROM best", "SELECT 'winner' AS state, fn, effect, CAST(hops AS BIGINT) AS hops, found FROM best"))
def surprise(m: Model) -> DataFrame:
    best = V.tour(m.functions(), m.stored_edges(), ("Db", "Net", "Fs"), 1, m.core())
    return R.surprise(best, m.functions())


@query("SELECT fn FROM nodes WHERE fn NOT LIKE 'app.infra.%'")
def trace_universe(m: Model) -> DataFrame:
    named = m.nodes().select(F.concat("fn", F.lit(".run")).alias("fn"))
    open_ = m.spark.createDataFrame([("app.infra",)], "package string")
    return R.universe(named, open_).select(F.regexp_replace("fn", r"\.run$", "").alias("fn"))


@query(Q._BASE + "SELECT i.fn, i.effect, CASE WHEN b.fn IS NULL THEN 'unknown' ELSE 'existing' END AS origin FROM (SELECT * FROM inferred EXCEPT SELECT * FROM old) i LEFT JOIN bnodes b ON i.fn = b.fn")
def gains_without_callgraph(m: Model) -> DataFrame:
    return V.gains(m.functions(), Q._base(m))


@query(f"""+ src AS (SELECT fn FROM reasons WHERE {Q._CLASS} IN ('dispatch', 'indirect')), s(source, node) AS (SELECT e.callee, e.caller FROM edges e JOIN src r ON e.callee = r.fn UNION SELECT s.source, e.caller FROM s JOIN edges e ON e.callee = s.node)
SELECT r.fn, r.classes, count(s.node) AS n_reach FROM (SELECT fn, string_agg(DISTINCT {Q._CLASS}, ',') AS classes FROM reasons WHERE fn IN (SELECT fn FROM src) GROUP BY fn) r LEFT JOIN s ON s.source = r.fn AND s.node <> r.fn GROUP BY ALL""")
def blindspots_class(m: Model) -> DataFrame:
    return V.blindspots(m.stored_edges(), m.reasons(), N.reason_filter("dispatch, indirect"), m.components(), m.core())


@query(Q._CLASSES + "SELECT DISTINCT i.fn FROM inferred i JOIN rc ON rc.fn = i.fn AND rc.class = 'reflect' WHERE i.effect = 'Unknown' AND split_part(i.fn, '.', 2) = 'domain' AND NOT EXISTS (SELECT 1 FROM inferred x WHERE x.fn = i.fn AND x.effect = 'Exec')")
def unverified_class(m: Model) -> DataFrame:
    rules = P.parse("deny Exec domain")
    return V.unverified(Q._gate_rows(m), P.denied(Q._gate_rows(m), rules), N.scope_matches(N.segments(F.col("fn")), "domain"), N.reason_filter("reflect"))


@query("""+ seen AS (SELECT DISTINCT fn, effect FROM observed WHERE effect <> 'Log'), ok AS (SELECT fn, effect FROM inferred UNION SELECT fn, 'Db' FROM inferred WHERE effect = 'Net'),
v AS (SELECT s.fn, string_agg(s.effect, ',' ORDER BY s.effect) AS observed, coalesce(string_agg(s.effect, ',' ORDER BY s.effect) FILTER (i.fn IS NULL), '') AS escaped FROM seen s LEFT JOIN ok i ON i.fn = s.fn AND i.effect = s.effect GROUP BY s.fn)
SELECT fn, CASE WHEN escaped = '' THEN 'clean' WHEN fn IN (SELECT fn FROM inferred WHERE effect = 'Unknown') THEN 'disclosed' ELSE 'violation' END AS verdict, observed, escaped FROM v""")
def verify_all(m: Model) -> DataFrame:
    return V.verify(m.observed(), m.functions(), V.SCOPES["all"])


@query("""+ c(fn) AS (SELECT caller FROM edges WHERE callee = 'app.domain.P1' UNION SELECT e.caller FROM c JOIN edges e ON e.callee = c.fn)
SELECT fn, 'caller' AS how, '' AS via FROM c UNION SELECT fn, 'frontier', 'P1' FROM reasons WHERE why LIKE 'dispatch:%' AND fn NOT IN (SELECT fn FROM c) AND fn <> 'app.domain.P1'""")
def callers_include_unknown(m: Model) -> DataFrame:
    # The open call names the type app.Base and, in place of run, the target's own member.
    reasons = m.reasons().withColumn("why", F.replace("why", F.lit("app.Base.run"), F.lit("app.Base.P1")))
    supers = m.spark.createDataFrame([("app.domain", "app.Base")], "type string, super string")
    indexed = m.spark.createDataFrame([("app.domain",), ("app.Base",), ("app.api",)], "type string")
    return V.callers_with_frontier(m.stored_edges(), "app.domain.P1", reasons, supers, indexed)


@query("+ cr AS (SELECT 'app.dao.S' || s_suppkey AS fn, 'Rand' AS effect FROM supplier WHERE s_acctbal < 1000), x(fn, effect) AS (SELECT fn, effect FROM direct UNION SELECT * FROM cr UNION SELECT e.caller, x.effect FROM edges e JOIN x ON e.callee = x.fn) SELECT fn, string_agg(effect, ',' ORDER BY effect) AS effects FROM x GROUP BY fn")
def effect_fixpoint_cross(m: Model) -> DataFrame:
    cross = m.table("supplier").filter("s_acctbal < 1000").select(F.concat(F.lit("app.dao.S"), F.col("s_suppkey").cast("string")).alias("fn"), F.lit(BIT["Rand"]).alias("mask"))
    return effect_fixpoint(m.stored_edges(), m.masks(), cross, core=m.core()).select("fn", _told().alias("effects"))


# ---------------------------------------------------------------- gates

ALLOW = P.parse("allow Fs in domain /var/lib/44 /var/lib/45\nallow Exec git\nallow Db in infra ledger.*\nallow Db in dao ledger.kenya")
_LITS = "+ lv(fn, effect, value) AS (SELECT fn, effect, value FROM literals UNION SELECT e.caller, lv.effect, lv.value FROM lv JOIN edges e ON e.callee = lv.fn) "


def _closed_literals(m: Model) -> DataFrame:
    pairs = m.literals().select("fn", F.to_json(F.struct("effect", "value")).alias("value"))
    closed = value_fixpoint(m.stored_edges(), pairs, core=m.core()).withColumn("x", F.from_json("value", "effect string, value string"))
    return closed.select("fn", "x.effect", "x.value")


def _allow_sql() -> str:
    parts = []
    for text, effect, scope, ok in [(r.text, r.effects[0], r.scope, c) for r, c in zip(ALLOW, ("value LIKE '/var/lib/44/%' OR value LIKE '/var/lib/45/%'", "split_part(split_part(value, ' ', 1), '/', -1) = 'git'", "value LIKE 'ledger.%'", "value = 'ledger.kenya'"))]:
        where = f" AND split_part(i.fn, '.', 2) = '{scope}'" if scope else ""
        parts.append(f"SELECT 'AS-EFF-008' AS code, '{text}' AS rule, i.fn, '{effect}' AS effects, coalesce(string_agg(DISTINCT lv.value, ',' ORDER BY lv.value) FILTER (NOT ({ok})), '') AS reached FROM inferred i LEFT JOIN lv ON lv.fn = i.fn AND lv.effect = i.effect WHERE i.effect = '{effect}'{where} GROUP BY i.fn HAVING count(lv.value) = 0 OR count(lv.value) FILTER (NOT ({ok})) > 0")
    return " UNION ALL ".join(parts)


@query(_LITS + _allow_sql())
def gate_allow_kinds(m: Model) -> DataFrame:
    return P.outside_allowlist(m.functions(), _closed_literals(m), ALLOW)


_KEPT = Q._GATE + """, acc(fn, rule, accepted) AS (VALUES ('app.dao.S3', 'deny Net[unknown-host] dao', 'Net'), ('app.domain.P1', 'deny Net Db domain', 'Net'), ('app.infra.R0', 'pure infra.R', 'Net')),
kept AS (SELECT v.* FROM viol v WHERE NOT EXISTS (SELECT 1 FROM acc a WHERE a.fn = v.fn AND a.rule = v.rule AND v.effects = 'Net')),
stale AS (SELECT * FROM acc a WHERE NOT EXISTS (SELECT 1 FROM viol v WHERE a.fn = v.fn AND a.rule = v.rule)) """


@query(_KEPT + ", s AS (SELECT (SELECT count(*) FROM kept) AS v, (SELECT count(*) FROM stale) AS t) SELECT v AS n_violations, t AS n_stale, CAST(0 AS BIGINT) AS n_unjudged, CAST(0 AS BIGINT) AS n_ambiguous, CAST(3 AS BIGINT) AS n_unevaluated, false AS incomplete, v + t = 0 AS refused, CASE WHEN v + t > 0 THEN 1 ELSE 2 END AS exit FROM s")
def gate_verdict(m: Model) -> DataFrame:
    return G.gate(Q._gate_rows(m), Q.RULES)["verdict"]


@query(_KEPT + "SELECT * FROM kept")
def gate_report(m: Model) -> DataFrame:
    return G.gate(Q._gate_rows(m), Q.RULES)["violations"]


_WITHHELD = "SELECT 'deny Net[unknown-host] dao' AS rule, i.fn, 'Net' AS effect FROM inferred i WHERE i.effect = 'Net' AND split_part(i.fn, '.', 2) = 'dao' AND NOT EXISTS (SELECT 1 FROM hv WHERE hv.fn = i.fn AND hv.host <> 'db.internal:5432')"
_WITHHELD_HEAD = Q._HOSTS + f", wh AS ({_WITHHELD})"


def _without_classes(m: Model) -> DataFrame:
    """Functions with destinations, none where the only host left no class in the report."""
    seen = Q._hosts(m).filter("value <> 'db.internal:5432'").groupBy("fn").agg(F.collect_set(N.destination_class(F.col("value"))).alias("destinations"))
    return m.functions().join(seen, "fn", "left").withColumn("destinations", F.coalesce("destinations", F.array().cast("array<string>"))).withColumn("reasons", F.array(F.lit("unresolved")))


@query(Q._HOSTS + _WITHHELD)
def gate_withheld(m: Model) -> DataFrame:
    """Functions whose only host left no class in the report: the narrowed rule can't be answered there."""
    return G.unanswerable(_without_classes(m), Q.RULES)


MIXED = P.parse("""
deny Net Db domain
deny Net Net[known-partner] api
deny Net[unknown-host] dao
deny Fs Exec domain
forbid api -> infra.N
accept app.dao.S3 Net for deny Net[unknown-host] dao because no evidence
accept app.domain.P1 Net for deny Net Db domain because older
accept app.domain.P2 Db Net for deny Net Db domain because two of that name
accept app.domain.P9 Fs for deny Fs Exec domain because reviewed
accept app.api.C1 Db for forbid api -> infra.N because a scan says
""")
_MIXED = _WITHHELD_HEAD + f""", v2 AS (
  SELECT 'deny Net Db domain' AS rule, fn, string_agg(effect, ',' ORDER BY effect) AS effects FROM inferred WHERE split_part(fn, '.', 2) = 'domain' AND effect IN ('Net', 'Db') GROUP BY fn
  UNION ALL SELECT 'deny Net Net[known-partner] api', fn, 'Net' FROM inferred WHERE split_part(fn, '.', 2) = 'api' AND effect = 'Net'
  UNION ALL SELECT DISTINCT 'deny Net[unknown-host] dao', fn, 'Net' FROM hv WHERE split_part(fn, '.', 2) = 'dao' AND host <> 'db.internal:5432' AND {Q._HOST_CLASS} = 'unknown-host'
  UNION ALL SELECT 'deny Fs Exec domain', fn, string_agg(effect, ',' ORDER BY effect) FROM inferred WHERE split_part(fn, '.', 2) = 'domain' AND effect IN ('Fs', 'Exec') GROUP BY fn),
ac(fn, rule, accepted) AS (VALUES ('app.dao.S3', 'deny Net[unknown-host] dao', 'Net'), ('app.domain.P1', 'deny Net Db domain', 'Net'), ('app.domain.P2', 'deny Net Db domain', 'Db,Net'), ('app.domain.P9', 'deny Fs Exec domain', 'Fs'), ('app.api.C1', 'forbid api -> infra.N', 'Db')),
jd AS (SELECT ac.fn, ac.rule, coalesce(v2.effects, '') AS effects, coalesce(array_to_string([e FOR e IN string_split(v2.effects, ',') IF NOT list_contains(string_split(accepted, ','), e)], ','), '') AS outside,
  CASE WHEN starts_with(ac.rule, 'forbid') OR ac.rule IN (SELECT rule FROM wh) THEN 'unjudged' WHEN ac.fn IN (SELECT 'app.domain.P' || p_partkey FROM part WHERE p_partkey % 10 = 2) THEN 'ambiguous' WHEN v2.fn IS NULL THEN 'stale'
  WHEN len([e FOR e IN string_split(v2.effects, ',') IF NOT list_contains(string_split(accepted, ','), e)]) = 0 THEN 'accepted' ELSE 'exceeded' END AS status FROM ac LEFT JOIN v2 ON v2.fn = ac.fn AND v2.rule = ac.rule),
kp AS (SELECT * FROM v2 WHERE NOT EXISTS (SELECT 1 FROM jd WHERE jd.fn = v2.fn AND jd.rule = v2.rule AND status = 'accepted')) """


def _mixed(m: Model) -> dict[str, DataFrame]:
    """A report with functions whose hosts left no class, union rows, and names that two units share."""
    parts = m.table("part").select("p_partkey", F.expr("concat('app.domain.P', p_partkey)").alias("fn"))
    same = G.twins(parts.select("fn", F.lit("a").alias("key")).union(parts.filter("p_partkey % 10 = 2").select("fn", F.lit("b"))))
    unions = m.table("supplier").select(F.expr("concat('app.domain.I', s_suppkey)").alias("fn"), F.lit(BIT["Db"]).alias("mask"), F.array(F.lit("unresolved")).alias("reasons"), F.array().cast("array<string>").alias("destinations"), F.lit(True).alias("interface_union"))
    rows = _without_classes(m).select("fn", "mask", "reasons", "destinations", F.lit(False).alias("interface_union"))
    return G.gate(rows.unionByName(unions), MIXED, None, same)


@query(_MIXED + "SELECT status, fn, rule, effects, outside FROM jd")
def gate_judged(m: Model) -> DataFrame:
    return _mixed(m)["accepts"]


@query(_MIXED + ", s AS (SELECT (SELECT count(*) FROM kp) AS v, (SELECT count(*) FROM jd WHERE status = 'stale') AS t) SELECT v AS n_violations, t AS n_stale, (SELECT count(*) FROM jd WHERE status = 'unjudged') AS n_unjudged, (SELECT count(*) FROM jd WHERE status = 'ambiguous') AS n_ambiguous, 1 + (SELECT count(DISTINCT rule) FROM wh) AS n_unevaluated, false AS incomplete, v + t = 0 AS refused, CASE WHEN v + t > 0 THEN 1 ELSE 2 END AS exit FROM s")
def gate_mixed_verdict(m: Model) -> DataFrame:
    return _mixed(m)["verdict"]


@query(_MIXED + "SELECT 'verdict' AS part, count(*) AS n FROM (SELECT 1) UNION ALL SELECT 'violations', (SELECT count(*) FROM kp) UNION ALL SELECT 'unevaluated', 1 + (SELECT count(DISTINCT rule) FROM wh)")
def gate_document(m: Model) -> DataFrame:
    """The verdict document by its parts, from the JSON that it consists of."""
    rows = G.document(_mixed(m)).withColumn("ok", F.try_parse_json("json").isNotNull())
    return rows.filter("ok").groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('allow Net in dao api.stripe.com sentry.io', 'a report doesn''t say that all literals were seen'), ('forbid api -> infra.N', 'a report''s calls leave out pure functions, through which the layer may be crossed'), ('only dao -> infra.R', 'a report''s calls aren''t all that a scope reaches')) r(rule, why)", views=False)
def gate_unevaluable(m: Model) -> DataFrame:
    return G.unevaluable(m.spark, Q.RULES)


@query(Q._CALLERS + f""", aff AS (SELECT fn FROM up UNION SELECT '{Q.TARGET}')
SELECT fn, 'deny Net Db domain' AS rule, false AS conditional FROM aff WHERE split_part(fn, '.', 2) = 'domain' UNION ALL SELECT fn, 'pure infra.R', false FROM aff WHERE fn LIKE 'app.infra.R%' UNION ALL SELECT fn, 'deny Net[unknown-host] dao', true FROM aff WHERE split_part(fn, '.', 2) = 'dao'""")
def whatif_policy(m: Model) -> DataFrame:
    return G.whatif(V.whatif(m.functions(), m.stored_edges(), Q.TARGET, "Net"), Q.RULES, "Net")


@query("""SELECT * FROM (VALUES ('deny Net Db domain', 'deny Db Net domain', 'deny Db Net Unknown domain'), ('deny Fs api', 'deny Fs api', 'deny Fs Unknown api'), ('pure infra.R', 'pure infra.R', 'deny Unknown infra.R'),
('deny Unknown[dispatch,unresolved] api', 'deny Unknown[dispatch,unresolved] api', 'deny Unknown[dispatch,native,unresolved] api'), ('deny Net[unknown-host] dao', 'deny Net[unknown-host] dao', 'deny Net[unknown-host] Unknown dao')) r(rule, canonical, upgraded)""", views=False)
def policy_canonical(m: Model) -> DataFrame:
    rows = [(r.text, G.canonical(r), G.upgrade(r, {"native"})) for r in Q.RULES if r.kind in ("deny", "pure")]
    return m.spark.createDataFrame(rows, "rule string, canonical string, upgraded string")


@query("""SELECT '{"deny": [{"effects": ["Db", "Net"], "scope": "domain"}, {"effects": ["Fs"], "scope": "api"}, {"effects": ["Net"], "scope": "dao", "netClasses": ["unknown-host"]}, {"effects": ["Unknown"], "scope": "api", "unknownClasses": ["dispatch", "unresolved"]}, {"effects": [], "scope": "infra.R"}], "allow": [{"effect": "Net", "scope": "dao", "values": ["api.stripe.com", "sentry.io"]}], "forbid": [{"from": "api", "to": "infra.N"}], "only": [{"from": "dao", "to": ["infra.R"]}]}' AS json""", views=False)
def policy_as_json(m: Model) -> DataFrame:
    return m.spark.createDataFrame([(G.policy_json(Q.RULES),)], "json string")


_BAD = "deny Net api\ndeny Nett dao # two t\npure infra\naccept x Net for deny Net api because y"


@query("SELECT * FROM (VALUES ('deny Net api', false), ('deny Nett dao', true), ('pure infra', false)) r(rule, bad)", views=False)
def policy_refused(m: Model) -> DataFrame:
    return G.P.unhonoured(m.spark, _BAD).select("rule", F.contains("why", F.lit("Nett")).alias("bad"))


@query("SELECT 2 AS line, 'allways Net' AS text, 'unknown rule ''allways''' AS reason", views=False)
def policy_ignored(m: Model) -> DataFrame:
    return P.ignored_lines(m.spark, "deny Net api\nallways Net # a slip\npure infra")


@query(Q._HOSTS + f""", c AS (SELECT i.fn, CASE WHEN split_part(i.fn, '.', 2) = 'domain' THEN 'deny Net Db domain' WHEN i.fn LIKE 'app.infra.R%' THEN 'pure infra.R' WHEN split_part(i.fn, '.', 2) = 'dao' AND (NOT EXISTS (SELECT 1 FROM hv WHERE hv.fn = i.fn) OR EXISTS (SELECT 1 FROM hv WHERE hv.fn = i.fn AND {Q._HOST_CLASS} = 'unknown-host')) THEN 'deny Net[unknown-host] dao' END AS rule FROM inferred i WHERE i.effect = 'Net') SELECT fn, rule FROM c WHERE rule IS NOT NULL""")
def denying_rule(m: Model) -> DataFrame:
    rows = Q._gate_rows(m).filter(V.has("Net")).select("fn", G.denying_rule(Q.RULES, "Net").alias("rule"))
    return rows.filter("rule is not null")


@query(_KEPT + """SELECT CASE WHEN v.fn IS NULL THEN 'remove' WHEN v.effects <> 'Net' THEN 'review' ELSE 'keep' END AS action, a.fn, a.rule, 'accept ' || a.fn || ' Net for ' || a.rule || ' because ' || CASE a.fn WHEN 'app.dao.S3' THEN 'reviewed' WHEN 'app.domain.P1' THEN 'older' ELSE 'never' END AS line FROM acc a LEFT JOIN viol v ON v.fn = a.fn AND v.rule = a.rule
UNION ALL SELECT 'add', v.fn, v.rule, 'accept ' || v.fn || ' ' || replace(v.effects, ',', ' ') || ' for ' || v.rule || ' because seen' FROM viol v WHERE NOT EXISTS (SELECT 1 FROM acc a WHERE a.fn = v.fn AND a.rule = v.rule)""")
def accepts_refreshed(m: Model) -> DataFrame:
    return G.refreshed(P.denied(Q._gate_rows(m), Q.RULES), Q.RULES, "seen")


@query(_KEPT + """SELECT CASE WHEN a.rule = 'pure infra.R' THEN 'unjudged' WHEN a.fn = 'app.domain.P1' THEN 'ambiguous' WHEN v.fn IS NULL THEN 'stale' WHEN v.effects = 'Net' THEN 'accepted' ELSE 'exceeded' END AS status, a.fn FROM acc a LEFT JOIN viol v ON a.fn = v.fn AND a.rule = v.rule""")
def accepts_status(m: Model) -> DataFrame:
    frame = lambda c, x: m.spark.createDataFrame([(x,)], f"{c} string")
    return P.judge_accepts(P.denied(Q._gate_rows(m), Q.RULES), Q.RULES, frame("rule", "pure infra.R"), frame("fn", "app.domain.P1")).select("status", "fn")


@query("SELECT 'pkg.' || n_name AS fn FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(DISTINCT c_mktsegment) > 1", views=False)
def twin_names(m: Model) -> DataFrame:
    rows = m.table("customer").join(m.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return G.twins(rows.select(F.concat(F.lit("pkg."), "n_name").alias("fn"), F.col("c_mktsegment").alias("key")))


@query("""WITH c AS (SELECT c_custkey AS k, 'a.C' || c_custkey AS cls, c_acctbal AS b FROM customer),
v AS (SELECT cls || '.run' AS fn, 'Db,Net' AS effects FROM c UNION ALL SELECT cls || '.lambda$run$0', 'Net' FROM c UNION ALL SELECT cls || '.lambda$lambda$run$0$1', CASE WHEN b > 5000 THEN 'Fs,Net' ELSE 'Db' END FROM c UNION ALL SELECT cls || '.lambda$new$2', 'Net' FROM c)
SELECT v.fn, v.effects, CASE WHEN v.fn LIKE '%$new$%' THEN NULL WHEN c.b <= 0 THEN NULL WHEN v.effects = 'Fs,Net' THEN NULL ELSE c.cls || '.run' END AS accepted_by FROM v JOIN c ON split_part(v.fn, '.', 2) = 'C' || c.k""", views=False)
def accepts_of_lambdas(m: Model) -> DataFrame:
    """Lambdas in methods whose violation is accepted; a lambda in a lambda climbs twice, by the call of the outer one."""
    c = m.table("customer").select(F.concat(F.lit("a.C"), F.col("c_custkey").cast("string")).alias("cls"), F.col("c_acctbal").alias("b"))
    names = lambda tail: F.concat("cls", F.lit(tail))
    row = lambda tail, effects: c.select(names(tail).alias("fn"), F.lit("r").alias("rule"), effects.alias("effects"))
    net, db = F.array(F.lit("Net")), F.array(F.lit("Db"), F.lit("Net"))
    deep = F.when(F.col("b") > 5000, F.array(F.lit("Fs"), F.lit("Net"))).otherwise(F.array(F.lit("Db")))
    v = row(".run", db).unionByName(row(".lambda$run$0", net)).unionByName(row(".lambda$lambda$run$0$1", deep)).unionByName(row(".lambda$new$2", net))
    accepts = c.filter("b > 0").select(names(".run").alias("fn"), F.lit("r").alias("rule"), db.alias("effects"))
    edges = c.select(names(".run").alias("caller"), names(".lambda$run$0").alias("callee")).unionByName(c.select(names(".lambda$run$0").alias("caller"), names(".lambda$lambda$run$0$1").alias("callee")))
    return G.settle(v, accepts, edges).select("fn", F.array_join("effects", ",").alias("effects"), "accepted_by")


@query("SELECT 'a.P' || p_partkey || '$1.run' AS fn, CASE WHEN p_size > 25 THEN 'a.P' || p_partkey || '.make' ELSE '' END AS creators FROM part", views=False)
def accepts_positional(m: Model) -> DataFrame:
    k = F.concat(F.lit("a.P"), F.col("p_partkey").cast("string"))
    parts = m.table("part")
    edges = parts.filter("p_size > 25").select(F.concat(k, F.lit(".make")).alias("caller"), F.concat(k, F.lit("$1.run")).alias("callee")).unionByName(parts.select(F.concat(k, F.lit("$1.go")).alias("caller"), F.concat(k, F.lit("$1.run")).alias("callee")))
    return G.positional(parts.select(F.concat(k, F.lit("$1.run")).alias("fn")), edges).select("fn", F.array_join("creators", ",").alias("creators"))


@query("SELECT 'AS-EFF-007' AS code, 'S' || l_suppkey AS fn, string_agg(DISTINCT CASE l_returnflag WHEN 'R' THEN 'Exec' ELSE 'Db' END, ',' ORDER BY CASE l_returnflag WHEN 'R' THEN 'Exec' ELSE 'Db' END) AS effects FROM lineitem WHERE l_returnflag <> 'N' AND l_linestatus = 'F' GROUP BY l_suppkey", views=False)
def gate_taint(m: Model) -> DataFrame:
    mask = F.when(F.col("l_returnflag") == "R", BIT["Exec"]).when(F.col("l_returnflag") == "A", BIT["Db"]).otherwise(BIT["Unknown"])
    return G.tainted(m.table("lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("fn"), mask.alias("mask"), (F.col("l_linestatus") == "F").alias("derived")))


# ---------------------------------------------------------------- report rows

_DISPATCH = "+ dr(fn) AS (SELECT fn FROM reasons WHERE why LIKE 'dispatch:%' UNION SELECT e.caller FROM dr JOIN edges e ON e.callee = dr.fn) "


def _dispatching(m: Model) -> DataFrame:
    return R.dispatch_reach(m.stored_edges(), m.reasons().filter("why like 'dispatch:%'"))


@query(_DISPATCH + "SELECT fn FROM dr")
def dispatch_reach(m: Model) -> DataFrame:
    return _dispatching(m)


@query(_DISPATCH + "SELECT fn FROM nodes WHERE fn IN (SELECT fn FROM inferred) OR fn IN (SELECT fn FROM entry_points) OR fn IN (SELECT fn FROM dr)")
def retained_rows(m: Model) -> DataFrame:
    return R.retained(m.functions(), _dispatching(m)).select("fn")


@query(_DISPATCH + "SELECT caller, callee FROM edges WHERE callee IN (SELECT fn FROM inferred) OR callee IN (SELECT fn FROM dr)")
def retained_calls(m: Model) -> DataFrame:
    return R.retained_calls(m.stored_edges(), m.functions(), _dispatching(m))


_KINDS = "+ k(fn, value) AS (SELECT 'app.domain.P' || p_partkey, CASE WHEN p_size = 50 THEN '?' WHEN p_retailprice < 1000 THEN 'read' ELSE 'write' END FROM part WHERE p_size >= 44 UNION SELECT e.caller, k.value FROM k JOIN edges e ON e.callee = k.fn), fk AS (SELECT fn, string_agg(DISTINCT value, ',' ORDER BY value) AS kinds FROM k GROUP BY fn HAVING count(*) FILTER (value = '?') = 0) "


def _fs_kinds(m: Model) -> DataFrame:
    kind = F.when(F.col("p_size") == 50, R.UNKNOWN_KIND).when(F.col("p_retailprice") < 1000, "read").otherwise("write")
    return R.fs_kinds(m.stored_edges(), m.table("part").filter("p_size >= 44").select(F.concat(F.lit("app.domain.P"), F.col("p_partkey").cast("string")).alias("fn"), kind.alias("value")))


@query(_KINDS + "SELECT fn, kinds FROM fk")
def fs_kinds(m: Model) -> DataFrame:
    return _fs_kinds(m).select("fn", F.array_join("kinds", ",").alias("kinds"))


@query(_KINDS + """, hit AS (SELECT fn FROM nodes WHERE contains(fn, 'domain.P1')),
t AS (SELECT h.fn, coalesce(string_agg(i.effect || CASE WHEN d.fn IS NULL THEN '' ELSE '*' END, ',' ORDER BY i.effect), '') AS inferred FROM hit h LEFT JOIN inferred i ON i.fn = h.fn LEFT JOIN direct d ON d.fn = i.fn AND d.effect = i.effect GROUP BY h.fn)
SELECT t.fn, CASE WHEN fk.kinds IS NULL THEN t.inferred ELSE regexp_replace(t.inferred, '\\bFs\\b', 'Fs(' || fk.kinds || ')') END AS inferred FROM t LEFT JOIN fk ON fk.fn = t.fn WHERE t.fn <> 'app.domain.P1' OR (SELECT count(*) FROM hit) > 0""".replace("contains(fn, 'domain.P1')", "fn LIKE '%n.P1%'"))
def show_kinds(m: Model) -> DataFrame:
    return R.show_kinds(V.show(m.functions(), "n.P1"), _fs_kinds(m)).select("fn", "inferred")


_UNIONS = Q._SUPERS.replace("'run' AS method FROM part WHERE p_size <= 16)", "'run' AS method, CASE WHEN p_size <= 5 THEN 'Net' WHEN p_size <= 10 THEN 'Db' ELSE 'Fs' END AS effect FROM part WHERE p_size <= 16)") + "cs(t, n) AS (SELECT type, super FROM sup UNION SELECT cs.t, sup.super FROM cs JOIN sup ON sup.type = cs.n)"


def _masked(m: Model) -> tuple[DataFrame, DataFrame]:
    _, supers, _ = Q._hierarchy(m)
    mask = F.when(F.col("p_size") <= 5, BIT["Net"]).when(F.col("p_size") <= 10, BIT["Db"]).otherwise(BIT["Fs"])
    return supers, m.table("part").filter("p_size <= 16").select(F.expr("concat('P', p_partkey)").alias("owner"), F.lit("run").alias("method"), mask.alias("mask"))


@query(_UNIONS + ", u AS (SELECT n || '.run' AS fn, string_agg(DISTINCT effect, ',' ORDER BY effect) AS effects FROM cs JOIN meth ON meth.owner = cs.t GROUP BY n), r AS (SELECT owner || '.run' AS fn, effect FROM meth) SELECT coalesce(r.fn, u.fn) AS key, coalesce(r.effect, u.effects) AS effects, CASE WHEN r.fn IS NOT NULL THEN u.effects END AS union_effects, r.fn IS NULL AS synthetic FROM r FULL JOIN u ON u.fn = r.fn")
def merged_unions(m: Model) -> DataFrame:
    supers, methods = _masked(m)
    real = methods.select(F.concat_ws(".", "owner", "method").alias("key"), "mask")
    both = R.merge_unions(real, V.union_rows(supers, methods).withColumnRenamed("fn", "key"))
    return both.select("key", _told().alias("effects"), F.when(F.col("union_mask").isNotNull(), _told("union_mask")).alias("union_effects"), "synthetic")


@query(_UNIONS + ", u AS (SELECT DISTINCT n || '.run' AS fn FROM cs JOIN meth ON meth.owner = cs.t), r AS (SELECT owner || '.run' AS fn FROM meth), e AS (SELECT 'C' || c_custkey AS caller, 'P' || c_custkey % (SELECT count(*) FROM part) || '.run' AS callee FROM customer) SELECT caller, callee FROM e UNION ALL SELECT caller, callee || '#union' FROM e WHERE callee IN (SELECT fn FROM u) AND callee IN (SELECT fn FROM r)")
def calls_beside_unions(m: Model) -> DataFrame:
    supers, methods = _masked(m)
    real = methods.select(F.concat_ws(".", "owner", "method").alias("key"), "mask")
    both = R.merge_unions(real, V.union_rows(supers, methods).withColumnRenamed("fn", "key"))
    sites, _, _ = Q._hierarchy(m)
    return R.beside_unions(sites.select(F.col("site").alias("caller"), F.concat_ws(".", "owner", "method").alias("callee")), both)


@query(_UNIONS + f", rs AS (SELECT 'P' || p_partkey || '.run' AS fn, CASE WHEN p_retailprice < 950 THEN 'dispatch:x' WHEN p_retailprice < 1200 THEN 'reflect:y' ELSE 'other' END AS why FROM part) SELECT n || '.run' AS fn, string_agg(DISTINCT {Q._CLASS}, ',' ORDER BY {Q._CLASS}) AS classes FROM cs JOIN meth ON meth.owner = cs.t JOIN rs ON rs.fn = meth.owner || '.run' GROUP BY n")
def union_contributors(m: Model) -> DataFrame:
    supers, methods = _masked(m)
    why = F.when(F.col("p_retailprice") < 950, "dispatch:x").when(F.col("p_retailprice") < 1200, "reflect:y").otherwise("other")
    return R.contributors(supers, methods, m.table("part").select(F.expr("concat('P', p_partkey, '.run')").alias("fn"), why.alias("why")))


@query(_UNIONS + ", al AS (SELECT type FROM sup UNION SELECT super FROM sup UNION SELECT owner FROM meth), self AS (SELECT type AS t, type AS n FROM al UNION SELECT t, n FROM cs) SELECT n AS owner, 'run' AS method, count(DISTINCT t) AS n FROM self JOIN meth ON meth.owner = self.t GROUP BY self.n")
def override_counts(m: Model) -> DataFrame:
    supers, methods = _masked(m)
    return R.override_counts(supers, methods)


@query("""WITH RECURSIVE ty AS (SELECT 'P' || p_partkey AS type, p_brand = 'Brand#5' AS enum, p_size > 5 AS final FROM part WHERE p_retailprice > 905), pe AS (SELECT 'P' || p_partkey // 4 AS type, 'P' || p_partkey AS permitted FROM part WHERE p_partkey // 4 > 0 AND p_partkey // 4 <> p_partkey),
be(s, n) AS (SELECT DISTINCT pe.type, pe.type FROM pe JOIN ty ON ty.type = pe.type UNION SELECT be.s, pe.permitted FROM be JOIN pe ON pe.type = be.n),
j AS (SELECT be.s, ty.type IS NULL AS unseen, ty.type IS NULL OR (be.n NOT IN (SELECT type FROM pe) AND NOT ty.final) AS op FROM be LEFT JOIN ty ON ty.type = be.n)
SELECT ty.type, ty.enum OR NOT bool_or(op) AS closed, coalesce(bool_or(unseen), false) AS unseen FROM ty LEFT JOIN j ON j.s = ty.type GROUP BY ty.type, ty.enum HAVING ty.enum OR count(j.s) > 0""".replace("ty.enum OR NOT bool_or(op)", "ty.enum OR NOT coalesce(bool_or(op), true)"), views=False)
def closed_types(m: Model) -> DataFrame:
    parts = m.table("part")
    types = parts.filter("p_retailprice > 905").select(F.expr("concat('P', p_partkey)").alias("type"), (F.col("p_brand") == "Brand#5").alias("enum"), (F.col("p_size") > 5).alias("final"))
    permits = parts.filter("p_partkey div 4 > 0 and p_partkey div 4 <> p_partkey").select(F.expr("concat('P', p_partkey div 4)").alias("type"), F.expr("concat('P', p_partkey)").alias("permitted"))
    return R.closed_types(types, permits)


@query(Q._SUPERS + """re(n) AS (SELECT 'P1' UNION SELECT sup.type FROM re JOIN sup ON sup.super = re.n), pa AS (SELECT 'P' || p_partkey AS type, p_brand AS entity FROM part WHERE p_size > 30),
up(t, n, h) AS (SELECT n, n, 0 FROM re WHERE n <> 'P1' UNION SELECT up.t, sup.super, h + 1 FROM up JOIN sup ON sup.type = up.n)
SELECT t AS type, arg_min(pa.entity, h) AS entity FROM up JOIN pa ON pa.type = up.n GROUP BY t""")
def repository_entities(m: Model) -> DataFrame:
    _, supers, _ = Q._hierarchy(m)
    markers = m.spark.createDataFrame([("P1",)], "type string")
    return R.entities(supers, markers, m.table("part").filter("p_size > 30").select(F.expr("concat('P', p_partkey)").alias("type"), F.col("p_brand").alias("entity")))


@query("SELECT l_suppkey AS key, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY l_suppkey", views=False)
def merged_deltas(m: Model) -> DataFrame:
    deltas = m.table("lineitem").select(F.col("l_suppkey").alias("key"), F.array("l_returnflag").alias("flags"), F.col("l_linenumber").cast("long").alias("n"))
    return R.merge_deltas(deltas, ["flags"], ["n"]).withColumn("flags", F.array_join("flags", ","))


@query("""WITH u AS (SELECT 'n.' || n_name AS fn, 'pkg' || n_regionkey AS package, 'k' || n_nationkey AS key, CASE WHEN n_regionkey IN (0, 2) THEN 'Net' ELSE '' END AS e FROM nation UNION ALL SELECT 'shared', 'pkg' || r_regionkey, 'r' || r_regionkey, 'Db' FROM region),
c AS (SELECT DISTINCT k.key AS caller, x.name FROM u k JOIN (SELECT 'k' || n_nationkey AS key, 'n.' || r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'k' || n_nationkey, 'shared' FROM nation) x ON x.key = k.key)
SELECT key, e || CASE WHEN key IN (SELECT u2.key FROM u u2 WHERE u2.key LIKE 'k%' AND NOT EXISTS (SELECT 1 FROM u s WHERE s.fn = 'shared' AND s.package = u2.package)) THEN CASE WHEN e = '' THEN 'Unknown' ELSE ',Unknown' END ELSE '' END AS effects FROM u""", views=False)
def gate_units(m: Model) -> DataFrame:
    """Units of report rows: a called name that its own package declares is that one's; here each region has one."""
    nation, region = m.table("nation"), m.table("region")
    none = F.array().cast("array<string>")
    more = [F.lit(False).alias("direct_unknown"), none.alias("reasons"), F.lit(False).alias("interface_union")]
    rows = nation.select(F.concat(F.lit("n."), "n_name").alias("fn"), F.expr("concat('k', n_nationkey)").alias("hash"), F.expr("concat('pkg', n_regionkey)").alias("package"), F.when(F.col("n_regionkey").isin(0, 2), BIT["Net"]).otherwise(0).alias("mask"), *more)
    rows = rows.unionByName(region.select(F.lit("shared").alias("fn"), F.expr("concat('r', r_regionkey)").alias("hash"), F.expr("concat('pkg', r_regionkey)").alias("package"), F.lit(BIT["Db"]).alias("mask"), *more))
    calls = nation.select(F.expr("concat('k', n_nationkey)").alias("hash"), F.concat(F.lit("n."), "n_name").alias("fn"), F.lit("shared").alias("name"))
    units, _ = R.gate_input(rows, calls)
    return units.select("key", _told().alias("effects"))


@query("""WITH c AS (SELECT DISTINCT owner, method, effect FROM (SELECT CASE l_linenumber WHEN 1 THEN 'java.io.File' WHEN 2 THEN 'java.net.Socket' WHEN 3 THEN 'java.lang.System' WHEN 4 THEN 'org.slf4j.Logger' WHEN 5 THEN 'java.sql.Statement' WHEN 6 THEN 'software.amazon.awssdk.services.bedrockruntime.Client' ELSE 'java.util.List' END AS owner, CASE l_returnflag WHEN 'A' THEN 'exists' WHEN 'N' THEN 'getenv' ELSE 'nanoTime' END AS method FROM lineitem) x
JOIN (VALUES ('java.io.File', 'exists', 'Fs'), ('java.net.Socket', '', 'Net'), ('java.lang.System', 'getenv', 'Env'), ('java.lang.System', 'nanoTime', 'Clock'), ('org.slf4j.Logger', '', 'Log'), ('java.sql.Statement', '', 'Db'), ('software.amazon.awssdk.services.bedrockruntime.Client', '', 'Llm')) r(o, m, effect) ON owner = o AND (m = '' OR m = method)) SELECT * FROM c""", views=False)
def classify_library_calls(m: Model) -> DataFrame:
    owner = F.expr("CASE l_linenumber WHEN 1 THEN 'java.io.File' WHEN 2 THEN 'java.net.Socket' WHEN 3 THEN 'java.lang.System' WHEN 4 THEN 'org.slf4j.Logger' WHEN 5 THEN 'java.sql.Statement' WHEN 6 THEN 'software.amazon.awssdk.services.bedrockruntime.Client' ELSE 'java.util.List' END")
    calls = m.table("lineitem").select(owner.alias("owner"), F.expr("CASE l_returnflag WHEN 'A' THEN 'exists' WHEN 'N' THEN 'getenv' ELSE 'nanoTime' END").alias("method"))
    return V.classify_calls(calls, m.spark.createDataFrame(K.rules(), "priority int, owner string, method_pattern string, effect string, descriptor string"))


# ---------------------------------------------------------------- reports on disk


_folders: dict[tuple, str] = {}


def _written(m: Model) -> str:
    """A folder with reports of the layers and their call graphs, written once a session, folder of tables and state of its
    files."""
    key = (m.spark.sparkContext.applicationId, m.sf_dir, file_state(m))
    if key not in _folders or not L.Store(m.spark).is_dir(_folders[key]):
        _folders[key] = _write(m)
    return _folders[key]


def _write(m: Model) -> str:
    top = f"{shared_dir(m.spark)}/.reports"
    layer = F.element_at(F.split("fn", r"\."), 2)
    rows = m.functions().withColumn("layer", layer)
    direct = m.functions().select("fn", names_of(F.col("direct_mask")).alias("direct"))
    empty = [F.array().cast("array<string>").alias(k) for k in S.LISTS if k not in ("inferred", "direct")]
    blank = [F.lit(False).alias(k) for k in S.FLAGS if k != "entryPoint"]
    for name in ("api", "dao", "domain", "infra"):
        own = rows.filter(F.col("layer") == name)
        n, digest = D.fnv1a(own.select(F.lit("x").alias("report"), F.col("fn").alias("name"))).select("n", "digest").first()
        kept = own.filter("mask <> 0 or entry_point").join(direct, "fn").select("fn", F.lit("").alias("loc"), F.lit("").alias("hash"), F.lit("function").alias("unitKind"), F.col("entry_point").alias("entryPoint"), *blank, names_of(F.col("mask")).alias("inferred"), "direct", *empty)
        envelope = {"head": {"version": "1.2" if name == "api" else "1.1", "toolchain": "t", "spec": "0.4"}, "packages": [f"app.{name}"], "analyzed": {"count": n, "digest": digest if name != "dao" else "0" * 16}, "switches": ["FAST"] if name == "infra" else [], "unanalyzed": [{"path": "a.b", "reason": "torn"}] if name == "dao" else []}
        E.write_report(kept, f"{top}/report.{name}.json", envelope)
        pairs = m.stored_edges().filter(F.element_at(F.split("caller", r"\."), 2) == name).select(F.col("caller").alias("source"), F.col("callee").alias("target"))
        E.write_pairs(S.pair_lines(pairs, own.select(F.col("fn").alias("source"))), f"{top}/report.{name}.callgraph.json")
    return top.removesuffix("/.reports")


@query("""SELECT n.fn, coalesce(string_agg(i.effect, ',' ORDER BY i.effect), '') AS inferred, n.fn IN (SELECT fn FROM entry_points) AS entry FROM nodes n LEFT JOIN inferred i ON i.fn = n.fn WHERE n.fn IN (SELECT fn FROM entry_points) OR n.fn IN (SELECT fn FROM inferred) GROUP BY n.fn""")
def report_round_trip(m: Model) -> DataFrame:
    """Reports written, found by their folder and read as one world."""
    rows = S.read_functions(m.spark, L.reports(m.spark, _written(m)))
    return rows.select("fn", F.array_join("inferred", ",").alias("inferred"), F.col("entryPoint").alias("entry"))


@query("SELECT caller AS source, callee AS target FROM edges")
def callgraph_round_trip(m: Model) -> DataFrame:
    found = L.reports(m.spark, _written(m))
    return S.read_pairs(m.spark, [L.sidecar(p, "callgraph") for p in found])[0]


@query("""SELECT split_part(fn, '.', 2) AS layer, CASE split_part(fn, '.', 2) WHEN 'api' THEN '1.2' ELSE '1.1' END AS version, count(*) AS n_analyzed, CASE split_part(fn, '.', 2) WHEN 'infra' THEN 'FAST' ELSE '' END AS switches, split_part(fn, '.', 2) = 'dao' AS incomplete FROM nodes GROUP BY 1""")
def report_envelopes(m: Model) -> DataFrame:
    e = E.envelopes(m.spark, L.reports(m.spark, _written(m)))
    return e.select(F.substring_index(F.col("packages")[0], ".", -1).alias("layer"), "version", "n_analyzed", F.array_join("switches", ",").alias("switches"), E.says_incomplete().alias("incomplete"))


@query("SELECT CAST(4 AS BIGINT) AS n_reports, CAST(1 AS INT) AS n_unanalyzed, true AS incomplete", views=False)
def report_completeness(m: Model) -> DataFrame:
    e = E.completeness(E.envelopes(m.spark, L.reports(m.spark, _written(m))))
    return e.select("n_reports", F.size("unanalyzed").alias("n_unanalyzed"), "incomplete")


@query("SELECT split_part(fn, '.', 2) AS layer, split_part(fn, '.', 2) <> 'dao' AS paired, count(*) AS n FROM nodes GROUP BY 1")
def dependency_pairing(m: Model) -> DataFrame:
    """Call graphs that belong to their reports by number and digest; one report tells another digest."""
    d = D.paired_callgraphs(m.spark, L.reports(m.spark, _written(m)))
    return d.select(F.regexp_extract("report", r"report\.(\w+)\.json$", 1).alias("layer"), "paired", "n")


@query("""+ b AS (SELECT split_part(fn, '.', 2) AS report, count(*) AS n, list_transform(string_split(string_agg(fn || chr(10), '' ORDER BY fn), ''), lambda c: ascii(c)::HUGEINT) AS bytes FROM nodes GROUP BY 1)
SELECT report, n, lpad(lower(to_hex(CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, bytes), lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS UBIGINT))), 16, '0') AS digest FROM b""")
def analyzed_digest(m: Model) -> DataFrame:
    return D.fnv1a(m.nodes().select(F.element_at(F.split("fn", r"\."), 2).alias("report"), F.col("fn").alias("name")))


@query("""WITH a AS (SELECT DISTINCT 'p.' || n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 5000), b AS (SELECT DISTINCT 'p.' || n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 4000)
SELECT name, 'now' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT name, 'gone' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""", views=False)
def coverage_delta(m: Model) -> DataFrame:
    rows = m.table("supplier").join(m.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    entry = F.struct(F.concat(F.lit("p."), "n_name").alias("name"), F.lit(1).cast("long").alias("calls"))
    of = lambda where: rows.filter(where).groupBy("s_nationkey").agg(F.collect_list(entry).alias("uncovered"))
    return E.coverage_delta(of("s_acctbal < 5000"), of("s_acctbal > 4000"))


# ---------------------------------------------------------------- functions over text


@query("SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 5000 THEN 'h' || c_custkey || '.example.com' ELSE NULL END AS host, CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 5000 THEN 'https://u@h' || c_custkey || '.example.com/a' ELSE 'https://h' END AS prefix FROM customer", views=False)
def concat_hosts(m: Model) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    recipe = F.when(F.col("c_acctbal") < 0, F.lit("\u0001/x")).when(F.col("c_acctbal") < 5000, F.concat(F.lit("https://u@h"), k, F.lit(".example.com/a\u0002b"))).otherwise(F.lit("https://h\u0001/x"))
    prefix = N.concat_prefix(recipe)
    return m.table("customer").select(F.col("c_custkey").alias("k"), N.concat_host(prefix).alias("host"), prefix.alias("prefix"))


@query("SELECT why, split_part(why, ':', 1) AS prefix, CASE WHEN contains(why, ':') THEN regexp_replace(why, '^[^:]*:', '') ELSE '' END AS detail FROM (SELECT DISTINCT l_shipdate::VARCHAR || ' x' AS why FROM lineitem UNION SELECT DISTINCT l_returnflag || ':a:b' FROM lineitem UNION SELECT DISTINCT l_returnflag FROM lineitem) WHERE why NOT LIKE '% x'", views=False)
def reason_parts(m: Model) -> DataFrame:
    flags = m.table("lineitem").select("l_returnflag").distinct()
    tags = flags.select(F.concat("l_returnflag", F.lit(":a:b")).alias("why")).union(flags)
    rows = tags.withColumn("p", N.reason_parts(F.col("why")))
    return rows.filter(N.reason_tag(F.col("p.prefix"), F.col("p.detail")) == F.col("why")).select("why", "p.prefix", "p.detail")


@query("SELECT p_partkey AS k, CASE WHEN p_size < 10 THEN '' ELSE 'org.x' || p_size END AS package FROM part", views=False)
def entry_packages(m: Model) -> DataFrame:
    s = F.col("p_size").cast("string")
    hash_ = F.when(F.col("p_size") < 10, F.concat(F.lit("C"), s, F.lit(".run()V"))).otherwise(F.concat(F.lit("org/x"), s, F.lit("/C.run(Ljava/lang/String;)V")))
    return m.table("part").select(F.col("p_partkey").alias("k"), hash_.alias("hash")).select("k", D.entry_package().alias("package"))


@query("SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 0 THEN 'absent' WHEN 1 THEN 'malformed' WHEN 2 THEN 'match' WHEN 3 THEN 'mismatch' ELSE 'undetermined' END AS verdict FROM supplier", views=False)
def version_pins(m: Model) -> DataFrame:
    k = F.col("s_suppkey") % 5
    pin = F.when(k == 1, "new").when(k == 2, "v1.2").when(k == 3, "1.3").when(k == 4, "1.2")
    return m.table("supplier").select(F.col("s_suppkey").alias("k"), N.version_pin(pin, F.when(k == 4, "unknown").otherwise("1.2.0")).alias("verdict"))


@query("SELECT p_partkey AS k, p_size BETWEEN 10 AND 30 AS path, p_size < 25 AS tab, CASE WHEN p_size < 25 THEN 'Net' WHEN p_size < 35 THEN 'Db' ELSE '' END AS command FROM part", views=False)
def literal_covers(m: Model) -> DataFrame:
    s = F.col("p_size")
    path = F.when(s < 10, "var/lib/a").when(s <= 30, "/var/lib/./a/b").when(s < 40, "/var/lib/a/../b").otherwise("/var/library/a")
    table = F.when(s < 25, "Ledger.Entries").otherwise("ledgers.entries")
    command = F.when(s < 25, "/usr/bin/curl -s x").when(s < 35, "psql -c y").otherwise("git fetch")
    return m.table("part").select(F.col("p_partkey").alias("k"), N.path_covered(F.lit("/var/lib"), path).alias("path"), N.table_covered(F.lit("ledger.*"), table).alias("tab"), F.array_join(N.command_effects(command), ",").alias("command"))


# ---------------------------------------------------------------- streams


def _observed_stream(m: Model) -> DataFrame:
    """fn, effect, ts of events read as a stream."""
    effect = F.when(F.col("event_type") == "view", "Db").when(F.col("event_type") == "click", "Net").when(F.col("event_type") == "purchase", "Fs").when(F.col("event_type") == "error", "Exec").otherwise("Log")
    source, stream = f"{m.sf_dir}/events.parquet", m.spark.readStream.schema(m.table("events").schema)
    events = stream.parquet(source) if L.Store(m.spark).is_dir(source) else stream.option("pathGlobFilter", "events.parquet").parquet(m.sf_dir)
    return events.select(F.concat(F.lit("app.api.C"), F.col("user_id").cast("string")).alias("fn"), effect.alias("effect"), F.col("ts").cast("timestamp").alias("ts"))


@query(Q._BASE + ", seen AS (SELECT DISTINCT fn, effect FROM observed WHERE effect IN ('Exec', 'Fs', 'Net')) SELECT fn, effect FROM seen s WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.fn = s.fn AND old.effect IN (s.effect, 'Unknown'))")
def trace_violations_stream(m: Model) -> DataFrame:
    """What a run was seen to do beyond the baseline's report, from the events read as a stream up to what is there."""
    out = shared_dir(m.spark)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.select("fn", "effect").write.mode("overwrite").parquet(f"{out}/batch={batch}")

    found = T.violations(_observed_stream(m), Q._base(m))
    found.writeStream.foreachBatch(keep).option("checkpointLocation", shared_dir(m.spark)).trigger(availableNow=True).start().awaitTermination()
    return m.spark.read.parquet(out).select("fn", "effect").distinct()


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, CASE event_type WHEN 'view' THEN 'Db' WHEN 'click' THEN 'Net' WHEN 'purchase' THEN 'Fs' WHEN 'error' THEN 'Exec' ELSE 'Log' END AS effect, count(*) AS n FROM events GROUP BY 1, 2", views=False)
def trace_counts_stream(m: Model) -> DataFrame:
    """Observations by hour and effect, from the events read as a stream up to what is there."""
    counts = T.counts(_observed_stream(m))
    out = shared_dir(m.spark)

    def keep(rows: DataFrame, batch: int) -> None:
        # A batch that is done again takes its own folder's place.
        rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "effect", "n").write.mode("overwrite").parquet(f"{out}/batch={batch}")

    # Only windows that a batch has changed are written, and those behind the watermark leave the state.
    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", shared_dir(m.spark)).trigger(availableNow=True).start().awaitTermination()
    return m.spark.read.parquet(out).groupBy("start", "effect").agg(F.max_by("n", "batch").alias("n"))
