"""Registered queries over a hierarchy of classes and interfaces laid over parts, each with the SQL that gives the same rows.

Part k is a class below part k div 4; every part lists two of fifty interfaces, which lie in a tree of their own. Parts of
small sizes and some interfaces have a body of run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberflow.functions.effects import BIT, names_of
from emberflow.operators import dispatch as H
from emberflow.operators import unions as U
from emberflow.operators.disclosure import disclose
from emberflow.plans.registry import query
from emberflow.plans.views import Model

_TYPES = """WITH RECURSIVE sup(type, super, kind, place) AS (
  SELECT 'P' || p_partkey, 'P' || p_partkey // 4, 'class', 1 FROM part WHERE p_partkey > 0
  UNION ALL SELECT 'P' || p_partkey, 'J' || p_partkey % 50, 'interface', 2 FROM part
  UNION ALL SELECT 'P' || p_partkey, 'J' || (p_partkey * 7 + 1) % 50, 'interface', 3 FROM part WHERE (p_partkey * 7 + 1) % 50 <> p_partkey % 50
  UNION ALL SELECT DISTINCT 'J' || p_partkey % 50, 'J' || p_partkey % 50 // 3, 'interface', 1 FROM part WHERE p_partkey % 50 > 0
), meth(owner) AS (
  SELECT 'P' || p_partkey FROM part WHERE p_size <= 3 UNION SELECT 'J' || p_partkey % 50 FROM part WHERE p_partkey % 50 % 4 = 1
), site(site, owner) AS (
  SELECT 'C' || c_custkey, 'P' || c_custkey % (SELECT count(*) FROM part) FROM customer
), hier(type, closed, unseen) AS (
  SELECT 'P' || p_partkey, p_partkey % 5 = 0, p_partkey % 7 = 3 FROM part
), """


def hierarchy(m: Model) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """sites, supers, methods and closedness of types."""
    parts = m.table("part").select("p_partkey", "p_size", F.expr("p_partkey % 50").alias("j"), F.expr("(p_partkey * 7 + 1) % 50").alias("i"))
    row = lambda rows, type_, super_, kind, place: rows.select(F.expr(type_).alias("type"), F.expr(super_).alias("super"), F.lit(kind).alias("kind"), F.lit(place).alias("place"))
    supers = row(parts.filter("p_partkey > 0"), "concat('P', p_partkey)", "concat('P', p_partkey div 4)", "class", 1)
    supers = supers.unionByName(row(parts, "concat('P', p_partkey)", "concat('J', j)", "interface", 2)).unionByName(row(parts.filter("i <> j"), "concat('P', p_partkey)", "concat('J', i)", "interface", 3))
    supers = supers.unionByName(row(parts.filter("j > 0").select("j").distinct(), "concat('J', j)", "concat('J', j div 3)", "interface", 1))
    methods = parts.filter("p_size <= 3").select(F.expr("concat('P', p_partkey)").alias("owner")).union(parts.filter("j % 4 = 1").select(F.expr("concat('J', j)"))).distinct().withColumn("method", F.lit("run"))
    n = parts.count()
    sites = m.table("customer").select(F.expr("concat('C', c_custkey)").alias("site"), F.expr(f"concat('P', c_custkey % {n})").alias("owner"), F.lit("run").alias("method"))
    closed = parts.select(F.expr("concat('P', p_partkey)").alias("type"), F.expr("p_partkey % 5 = 0").alias("closed"), F.expr("p_partkey % 7 = 3").alias("unseen"))
    return sites, supers, methods, closed


_RESOLVED = _TYPES + """own(o) AS (SELECT DISTINCT owner FROM site),
lo(o, n) AS (SELECT o, o FROM own UNION SELECT lo.o, sup.type FROM lo JOIN sup ON sup.super = lo.n),
dw AS (SELECT lo.o, lo.n FROM lo JOIN meth ON meth.owner = lo.n),
-- Superclasses first: the chain, and its first body.
ch(o, n, h) AS (SELECT o, o, 0 FROM own WHERE o NOT IN (SELECT o FROM dw) UNION SELECT ch.o, sup.super, h + 1 FROM ch JOIN sup ON sup.type = ch.n AND sup.kind = 'class'),
cb AS (SELECT o, arg_min(n, h) AS n FROM ch JOIN meth ON meth.owner = ch.n GROUP BY o),
-- Then interfaces, in the order in which a queue would give them.
it(o, n, level, way) AS (
  SELECT ch.o, sup.super, 0, [h, place] FROM ch JOIN sup ON sup.type = ch.n AND sup.kind = 'interface' WHERE ch.o NOT IN (SELECT o FROM cb)
  UNION SELECT it.o, sup.super, level + 1, list_append(way, place) FROM it JOIN sup ON sup.type = it.n),
ib AS (SELECT o, arg_min(n, {'level': level, 'way': way}) AS n FROM it JOIN meth ON meth.owner = it.n GROUP BY o),
up AS (SELECT * FROM cb UNION ALL SELECT * FROM ib) """


@query(_RESOLVED + "SELECT site, n || '.run' AS target FROM site JOIN up ON up.o = site.owner", views=False)
def inherited_bodies(m: Model) -> DataFrame:
    """The body that a call inherits where neither its owner nor a subtype has one: superclasses before interfaces."""
    sites, supers, methods, _ = hierarchy(m)
    found = H.dispatch(sites, supers, methods).filter("how = 'inherited'")
    return found.select("site", "target")


@query(_RESOLVED + """, sized AS (SELECT o, count(*) AS n FROM dw GROUP BY o), wide AS (SELECT o FROM sized LEFT JOIN hier ON hier.type = o WHERE n > 12 AND NOT coalesce(closed, false)),
al AS (SELECT o, n, 'below' AS how FROM dw WHERE o NOT IN (SELECT o FROM wide) UNION ALL SELECT o, NULL, 'wide' FROM wide UNION ALL SELECT o, n, 'inherited' FROM up)
SELECT site, al.n || '.run' AS target, coalesce(how, 'none') AS how, NOT coalesce(unseen, false) AND coalesce(how, 'none') <> 'wide' AS complete FROM site LEFT JOIN al ON al.o = site.owner LEFT JOIN hier ON hier.type = site.owner""", views=False)
def dispatch_closed(m: Model) -> DataFrame:
    """All calls: closed owners keep more than 12 bodies, others have none told beyond that; unseen subtypes are said."""
    return H.dispatch(*hierarchy(m))


_J = "CASE WHEN {0} < 20 THEN 'app.j.J' WHEN {0} < 35 THEN 'ext.lib.J' WHEN {0} < 45 THEN 'java.util.J' ELSE 'J' END"
_NAMED = f"CASE left(x, 1) WHEN 'P' THEN 'app.p.' || x ELSE {_J.format('CAST(substr(x, 2) AS INT)')} || substr(x, 2) END"


def _bit(size: str) -> str:
    return f"CASE WHEN {size} % 3 = 0 THEN 'Net' WHEN {size} % 3 = 1 THEN 'Db' END"


@query(_TYPES + f"""s2 AS (SELECT {_NAMED.replace('x', 'type')} AS type, {_NAMED.replace('x', 'super')} AS super FROM sup),
tp AS (SELECT 'app.p.P' || p_partkey AS type, false AS interface FROM part UNION SELECT {_J.format('p_partkey % 50')} || p_partkey % 50, true FROM part WHERE p_partkey % 50 < 20),
mt AS (SELECT 'app.p.P' || p_partkey AS owner, 'run' AS method, p_partkey % 6 = 0 AS abstract, {_bit('p_size')} AS effect FROM part WHERE p_size <= 20 UNION ALL SELECT 'app.p.P' || p_partkey, 'toString', false, 'Net' FROM part WHERE p_size > 45
  UNION ALL SELECT DISTINCT 'app.j.J' || p_partkey % 50, 'run', p_partkey % 50 % 4 <> 1, CASE p_partkey % 50 % 4 WHEN 1 THEN 'Fs' END FROM part WHERE p_partkey % 50 < 20),
lm AS (SELECT {_J.format('(s_suppkey % 31 + 10)')} || (s_suppkey % 31 + 10) AS owner, CASE s_suppkey % 5 WHEN 0 THEN 'call' ELSE 'run' END AS method, 'app.l.lambda$' || s_suppkey AS fn, {_bit('s_suppkey')} AS effect FROM supplier),
ab(type, of) AS (SELECT type, super FROM s2 WHERE type IN (SELECT type FROM tp) UNION SELECT ab.type, s2.super FROM ab JOIN s2 ON s2.type = ab.of),
fo AS (SELECT DISTINCT of FROM (SELECT of FROM ab UNION SELECT owner FROM lm) WHERE of NOT IN (SELECT type FROM tp) AND contains(of, '.') AND NOT starts_with(of, 'java.')),
cand AS (SELECT owner, method, 'own' AS arm FROM mt JOIN tp ON tp.type = mt.owner WHERE interface OR abstract
  UNION SELECT of, method, 'foreign' FROM mt JOIN ab ON ab.type = mt.owner WHERE NOT abstract AND method <> 'toString' AND of IN (SELECT of FROM fo)
  UNION SELECT owner, method, 'lambda' FROM lm WHERE owner IN (SELECT of FROM fo)),
c2 AS (SELECT owner, method, string_agg(arm, ',' ORDER BY CASE arm WHEN 'own' THEN 1 WHEN 'foreign' THEN 2 ELSE 3 END) AS arms FROM cand GROUP BY ALL),
bh AS (SELECT owner AS of, owner, method, effect FROM mt WHERE NOT abstract UNION ALL SELECT ab.of, owner, method, effect FROM mt JOIN ab ON ab.type = mt.owner WHERE NOT abstract),
x AS (SELECT c2.owner, c2.method, arms, (SELECT count(*) FROM bh WHERE bh.of = c2.owner AND bh.method = c2.method) AS nb, (SELECT count(*) FROM lm WHERE lm.owner = c2.owner AND lm.method = c2.method) AS nl,
  EXISTS (SELECT 1 FROM mt WHERE mt.owner = c2.owner AND mt.method = c2.method AND NOT abstract) AS real, EXISTS (SELECT 1 FROM hier WHERE closed AND 'app.p.' || hier.type = c2.owner) AS closed FROM c2),
y AS (SELECT *, NOT closed AND nb > 12 AS wide, NOT closed AND nl > 0 AND nb + nl > 12 AS wider FROM x WHERE nb + nl > 0),
ef AS (SELECT of AS owner, method, effect, false AS lam FROM bh UNION ALL SELECT owner, method, effect, true FROM lm)
SELECT owner || '.' || method AS fn, arms, CASE WHEN wide THEN 'Unknown' ELSE coalesce((SELECT string_agg(e, ',' ORDER BY e) FROM (SELECT DISTINCT effect AS e FROM ef WHERE ef.owner = y.owner AND ef.method = y.method AND effect IS NOT NULL AND NOT (lam AND wider) UNION SELECT 'Unknown' WHERE wider)), '') END AS effects,
  nb AS n_bodies, nl AS n_lambdas, CASE WHEN wide OR wider THEN 'dispatch:' || owner || '.' || method END AS why, real FROM y""", views=False)
def union_arms(m: Model) -> DataFrame:
    """Union rows of all three arms: interfaces of one's own, of a library and of modelled packages, and lambdas."""
    _, supers, _, closed = hierarchy(m)
    named = lambda c: F.expr(_NAMED.replace("x", c))
    bit = lambda size: F.when(F.expr(f"{size} % 3 = 0"), BIT["Net"]).when(F.expr(f"{size} % 3 = 1"), BIT["Db"]).otherwise(0)
    parts = m.table("part").select("p_partkey", "p_size", F.expr("p_partkey % 50").alias("j"))
    own = parts.filter("j < 20").select("j").distinct()
    types = parts.select(F.expr("concat('app.p.P', p_partkey)").alias("type"), F.lit(False).alias("interface")).union(own.select(F.expr("concat('app.j.J', j)"), F.lit(True)))
    methods = parts.filter("p_size <= 20").select(F.expr("concat('app.p.P', p_partkey)").alias("owner"), F.lit("run").alias("method"), F.expr("p_partkey % 6 = 0").alias("abstract"), bit("p_size").alias("mask"))
    methods = methods.union(parts.filter("p_size > 45").select(F.expr("concat('app.p.P', p_partkey)"), F.lit("toString"), F.lit(False), F.lit(BIT["Net"])))
    methods = methods.union(own.select(F.expr("concat('app.j.J', j)"), F.lit("run"), F.expr("j % 4 <> 1"), F.when(F.expr("j % 4 = 1"), BIT["Fs"]).otherwise(0)))
    k = "(s_suppkey % 31 + 10)"
    lambdas = m.table("supplier").select(F.expr(f"{_J.format(k)} || {k}").alias("owner"), F.expr("CASE s_suppkey % 5 WHEN 0 THEN 'call' ELSE 'run' END").alias("method"), F.expr("concat('app.l.lambda$', s_suppkey)").alias("fn"), bit("s_suppkey").alias("mask"))
    modelled = m.spark.createDataFrame([("java",)], "package string")
    shut = closed.filter("closed").select(F.concat(F.lit("app.p."), "type").alias("type"))
    rows = U.union_rows(types, supers.select(named("type").alias("type"), named("super").alias("super")), methods, lambdas, modelled, shut)
    return rows.select("fn", "arms", F.array_join(names_of(F.col("mask")), ",").alias("effects"), "n_bodies", "n_lambdas", "why", "real")


_SITES = "+ st(caller, body) AS (SELECT 'app.api.C' || c_custkey, 'app.domain.P' || c_custkey % 1000 FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'app.dao.S' || s_suppkey, 'app.domain.P' || s_suppkey * 3 FROM supplier UNION ALL SELECT 'app.infra.N' || n_nationkey, 'app.api.C' || (n_nationkey * 2 + 1) FROM nation WHERE n_nationkey % 5 = 2), "


@query(_SITES + """hit AS (SELECT DISTINCT caller FROM st JOIN inferred b ON b.fn = st.body WHERE NOT EXISTS (SELECT 1 FROM inferred c WHERE c.fn = st.caller AND c.effect = b.effect)),
unk(fn) AS (SELECT fn FROM inferred WHERE effect = 'Unknown' UNION SELECT caller FROM hit UNION SELECT l.caller FROM unk JOIN (SELECT caller, callee AS at FROM edges UNION ALL SELECT caller, body FROM st) l ON l.at = unk.fn)
SELECT fn, effect FROM inferred UNION SELECT fn, 'Unknown' FROM unk""")
def disclosed_effects(m: Model) -> DataFrame:
    """Effects after calls that can't be resolved have been disclosed, over as many turns as it takes."""
    row = lambda rows, caller, body: rows.select(F.expr(caller).alias("caller"), F.lit("app.Base.run").alias("via"), F.expr(body).alias("body"))
    sites = row(m.table("customer").filter("c_custkey % 3 = 0"), "concat('app.api.C', c_custkey)", "concat('app.domain.P', c_custkey % 1000)")
    sites = sites.unionByName(row(m.table("supplier"), "concat('app.dao.S', s_suppkey)", "concat('app.domain.P', s_suppkey * 3)"))
    sites = sites.unionByName(row(m.table("nation").filter("n_nationkey % 5 = 2"), "concat('app.infra.N', n_nationkey)", "concat('app.api.C', n_nationkey * 2 + 1)"))
    rows, _ = disclose(m.stored_edges(), m.inferred(), sites, core=m.core())
    return rows.select("fn", F.explode(names_of(F.col("mask"))).alias("effect"))
