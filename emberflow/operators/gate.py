"""One gate over a report: what a policy finds, what can't be judged, the verdict; and accept lines kept up to date."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberflow.functions import names as N
from emberflow.functions.effects import BIT, EFFECTS, mask_of, names_of
from emberflow.operators import policy as P
from emberflow.plans.runtime import stored

#: How many units outwards a lambda's row looks for an accepted one.
CLIMB = 8


def _narrowed(rule: P.Rule, effect: str, classes: tuple[str, ...] | None = None) -> str:
    own = classes if classes is not None and effect == "Unknown" else rule.reasons if effect == "Unknown" else rule.destinations if effect == "Net" else ()
    return effect + (f"[{','.join(sorted(own))}]" if own else "")


def canonical(rule: P.Rule) -> str:
    """A deny or pure rule as the matcher used it: effects and classes in order, aliases resolved."""
    scope = f" {rule.scope}" if rule.scope else ""
    if rule.kind == "pure":
        return "pure" + scope
    return "deny " + " ".join(_narrowed(rule, e) for e in sorted(set(rule.effects), key=EFFECTS.index)) + scope


def canonical_set(rules: list[P.Rule]) -> list[str]:
    return sorted({canonical(r) for r in rules if r.kind in ("deny", "pure")})


def upgrade(rule: P.Rule, classes: set[str] = frozenset()) -> str:
    """The smallest rule that would also catch Unknown of these classes where this one passed it."""
    scope = f" {rule.scope}" if rule.scope else ""
    if rule.kind == "pure":
        return "deny Unknown" + scope
    if "Unknown" in rule.effects and rule.reasons:
        wide = tuple(set(rule.reasons) | set(classes))
        return "deny " + " ".join(_narrowed(rule, e, wide) for e in sorted(set(rule.effects), key=EFFECTS.index)) + scope
    return "deny " + " ".join(_narrowed(rule, e) for e in sorted(set(rule.effects), key=EFFECTS.index)) + " Unknown" + scope


def narrowing(rule: P.Rule, effect: str) -> str | None:
    """The condition under which a narrowed rule bites, in words; None if it isn't narrowed for the effect."""
    if effect == "Unknown" and rule.reasons:
        return "the `Unknown` is of reason class " + " / ".join(sorted(rule.reasons))
    if effect == "Net" and rule.destinations:
        return "the `Net` reaches destination class " + " / ".join(sorted(rule.destinations))
    return None


def policy_json(rules: list[P.Rule]) -> str:
    """A policy as canonical JSON: kinds in order, rules of a kind by their own JSON."""
    def told(r: P.Rule) -> dict:
        if r.kind in ("deny", "pure"):
            return {"effects": [] if r.kind == "pure" else sorted(set(r.effects), key=EFFECTS.index), "scope": r.scope, **({"unknownClasses": sorted(r.reasons)} if r.reasons else {}), **({"netClasses": sorted(r.destinations)} if r.destinations else {})}
        if r.kind == "allow":
            return {"effect": r.effects[0], "scope": r.scope, "values": list(r.values)}
        return {"from": r.scope, "to": r.to[0] if r.kind == "forbid" else list(r.to)}

    kinds = {"deny": ("deny", "pure"), "allow": ("allow",), "forbid": ("forbid",), "only": ("only",)}
    return json.dumps({k: sorted((told(r) for r in rules if r.kind in of), key=json.dumps) for k, of in kinds.items()})


def denying_rule(rules: list[P.Rule], effect: str) -> Column:
    """The first deny or pure rule, in order of the policy, that forbids the effect to a function (fn, reasons,
    destinations); null without one."""
    out = F.lit(None).cast("string")
    segs = N.segments(F.col("fn"))
    for r in reversed([r for r in rules if r.kind in ("deny", "pure") and effect in r.effects]):
        bites = N.scope_matches(segs, r.scope)
        if effect == "Unknown" and r.reasons:
            bites = bites & F.arrays_overlap("reasons", F.array(*map(F.lit, r.reasons)))
        if effect == "Net" and r.destinations:
            bites = bites & F.arrays_overlap("destinations", F.array(*map(F.lit, r.destinations)))
        out = F.when(bites, F.lit(r.text)).otherwise(out)
    return out


def scope_covers(wide: str, narrow: str) -> bool:
    """Every function in the narrow scope is in the wide one: the wide's segments are a run of the narrow's, the last a
    beginning."""
    if not wide:
        return True
    a, b = N._parts(wide), N._parts(narrow)
    exact = wide.rstrip().endswith(("::", "."))
    return any(b[i : i + len(a) - 1] == a[:-1] and (b[i + len(a) - 1] == a[-1] if exact else b[i + len(a) - 1].startswith(a[-1])) for i in range(len(b) - len(a) + 1))


def unanswerable(functions: DataFrame, rules: list[P.Rule]) -> DataFrame:
    """rule, fn, effect: where a rule narrows by classes that a function's report has no evidence of. The effect is
    withheld there, not passed. functions: fn, mask, reasons, destinations (arrays, empty without evidence)."""
    if "interface_union" in functions.columns:
        functions = functions.filter(~F.coalesce("interface_union", F.lit(False)))
    segs, tests = N.segments(F.col("fn")), []
    for r in (r for r in rules if r.kind == "deny"):
        for effect, asked, column in (("Net", r.destinations, "destinations"), ("Unknown", r.reasons, "reasons")):
            if asked and effect in r.effects:
                gap = N.scope_matches(segs, r.scope) & (F.col("mask").bitwiseAND(BIT[effect]) != 0) & (F.size(column) == 0)
                tests.append(F.when(gap, F.struct(F.lit(r.text).alias("rule"), F.lit(effect).alias("effect"))))
    if not tests:
        return P._none(functions, "rule string, fn string, effect string")
    return functions.select("fn", F.explode(F.array_compact(F.array(*tests))).alias("x")).select("x.rule", "fn", "x.effect")


def unevaluable(spark: SparkSession, rules: list[P.Rule]) -> DataFrame:
    """rule, why: rules that a report can't answer, as it holds the effect-relevant calls only and no mark of whole
    literals."""
    why = {"forbid": "a report's calls leave out pure functions, through which the layer may be crossed", "only": "a report's calls aren't all that a scope reaches", "allow": "a report doesn't say that all literals were seen"}
    return spark.createDataFrame([(r.text, why[r.kind]) for r in rules if r.kind in why], "rule string, why string")


def gate(functions: DataFrame, rules: list[P.Rule], reports: DataFrame | None = None, same: DataFrame | None = None) -> dict[str, DataFrame]:
    """The gate over a report: violations that no accept line covers, every accept line with its status, what isn't
    evaluated, what was ignored for missing evidence, and the verdict (one row).

    An accept line counts as stale only if its rule was evaluated and its name is one unit's: else it is unjudged or
    ambiguous, covers nothing and is no fault of its own. reports: envelopes of the report set; same: fn of names that
    two units share (`twins`).
    """
    from emberflow.sources.envelope import completeness

    spark = functions.sparkSession
    found = stored(P.denied(functions, rules))
    withheld = stored(unanswerable(functions, rules))
    unevaluated = stored(unevaluable(spark, rules).select("rule").union(withheld.select("rule")).distinct())
    judged = stored(P.judge_accepts(found, rules, unevaluated, same))
    kept = found.join(judged.filter("status = 'accepted'").select("fn", "rule"), ["fn", "rule"], "left_anti")
    n_of = lambda status: F.count(F.when(F.col("status") == status, 1)).alias(f"n_{status}")
    counts = [kept.agg(F.count("*").alias("n_violations")), judged.agg(*map(n_of, ("stale", "unjudged", "ambiguous"))), unevaluated.agg(F.count("*").alias("n_unevaluated"))]
    whole = completeness(reports).select("incomplete") if reports is not None else spark.createDataFrame([(False,)], "incomplete boolean")
    # One row each.
    row = counts[0].crossJoin(counts[1]).crossJoin(counts[2]).crossJoin(whole)
    red = F.col("n_violations") + F.col("n_stale") > 0
    row = row.withColumn("refused", ~red & (F.col("n_unevaluated") > 0)).withColumn("exit", F.when(red, 1).when((F.col("n_unevaluated") > 0) | F.col("incomplete"), 2).otherwise(0))
    return {"violations": kept, "accepts": judged, "stale": judged.filter("status = 'stale'"), "withheld": withheld, "unevaluated": unevaluated, "verdict": row}


def document(result: dict[str, DataFrame]) -> DataFrame:
    """part, json: the verdict and every violation and rule not evaluated as JSON, one a row."""
    rows = [result[p].select(F.lit(p).alias("part"), F.to_json(F.struct("*")).alias("json")) for p in ("verdict", "violations", "unevaluated")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def advisory(answer: DataFrame, verdict: DataFrame) -> DataFrame:
    """An answer (one row, ok) with ok null where the verdict's report is incomplete or rules weren't evaluated: a claim
    must not be surer than the gate's."""
    doubt = verdict.select((F.col("incomplete") | (F.col("n_unevaluated") > 0)).alias("_doubt"))
    return answer.crossJoin(doubt).withColumn("ok", F.when(~F.col("_doubt"), F.col("ok"))).drop("_doubt")


def whatif(affected: DataFrame, rules: list[P.Rule], effect: str) -> DataFrame:
    """fn, rule, conditional: rules that would deny the effect to functions that gained it (fn); a narrowed rule is
    conditional, as classes aren't known beforehand."""
    segs = N.segments(F.col("fn"))
    tests = [F.when(N.scope_matches(segs, r.scope), F.struct(F.lit(r.text).alias("rule"), F.lit(narrowing(r, effect) is not None).alias("conditional"))) for r in rules if r.kind in ("deny", "pure") and effect in r.effects]
    if not tests:
        return P._none(affected, "fn string, rule string, conditional boolean")
    return affected.select("fn", F.explode(F.array_compact(F.array(*tests))).alias("x")).select("fn", "x.rule", "x.conditional")


def twins(units: DataFrame) -> DataFrame:
    """fn: names that two units with different keys share; units: fn, key."""
    return units.groupBy("fn").agg(F.countDistinct("key").alias("n")).filter("n > 1").select("fn")


_LAMBDA = r"^(.*)\.lambda\$(.+)\$\d+$"


def enclosing(fn: Column) -> Column:
    """The method that a lambda's name says it stands in; null for other names."""
    cls, method = F.regexp_extract(fn, _LAMBDA, 1), F.regexp_extract(fn, _LAMBDA, 2)
    inner = F.when(method == "new", "<init>").when(method == "static", "<clinit>").otherwise(method)
    return F.when(fn.rlike(_LAMBDA), F.concat(cls, F.lit("."), inner))


def settle(violations: DataFrame, accepts: DataFrame, edges: DataFrame, unusable: DataFrame | None = None) -> DataFrame:
    """fn, rule, effects, accepted_by: each violation (fn, rule, effects: array) and the accepted name that covers it, its
    own or, for a lambda, that of a method it stands in whose own accepted violation has these effects; null for none.

    accepts: fn, rule, effects (array). unusable: fn of names that can't be told apart. A lambda's method is told by its
    name, or by a caller that is an overload of it or a lambda of the same class; up to CLIMB steps outwards.
    """
    spark = violations.sparkSession
    ok = accepts if unusable is None else accepts.join(unusable, "fn", "left_anti")
    ok = ok.select("fn", "rule", F.col("effects").alias("may"))
    v = violations.select("fn", "rule", "effects")
    own = stored(v.join(ok, ["fn", "rule"]).filter(F.size(F.array_except("effects", "may")) == 0).select("fn", "rule", "effects").distinct())
    rest = v.join(own.select("fn", "rule"), ["fn", "rule"], "left_anti")
    at = stored(rest.filter(F.col("fn").rlike(_LAMBDA)).select("fn", "rule", "effects", F.col("fn").alias("cur")))
    inner = own.select(F.col("fn").alias("by"), F.col("rule").alias("_r"), F.col("effects").alias("had"))
    found = spark.createDataFrame([], "fn string, rule string, by string")
    for _ in range(CLIMB):
        if at.isEmpty():
            break
        cls = F.regexp_extract("cur", _LAMBDA, 1)
        called = at.join(edges.select(F.col("callee").alias("cur"), "caller"), "cur").filter(F.startswith("caller", F.concat(enclosing(F.col("cur")), F.lit("("))) | (F.col("caller").rlike(_LAMBDA) & F.startswith("caller", F.concat(cls, F.lit(".lambda$")))))
        up = stored(at.select("fn", "rule", "effects", enclosing(F.col("cur")).alias("up"), F.lit(0).alias("k")).unionByName(called.select("fn", "rule", "effects", F.col("caller").alias("up"), F.lit(1).alias("k"))).filter("up is not null"))
        hit = up.join(inner, (F.col("up") == F.col("by")) & (F.col("rule") == F.col("_r"))).filter(F.size(F.array_except("effects", "had")) == 0)
        found = stored(found.unionByName(hit.groupBy("fn", "rule").agg(F.min("by").alias("by"))))
        nxt = up.join(found.select("fn", "rule"), ["fn", "rule"], "left_anti").groupBy("fn", "rule").agg(F.first("effects").alias("effects"), F.min(F.struct("k", "up")).alias("m"))
        at = stored(nxt.select("fn", "rule", "effects", F.col("m.up").alias("cur")).filter(F.col("cur").rlike(_LAMBDA)))
    named = own.select("fn", "rule", F.col("fn").alias("by")).unionByName(found)
    return v.join(named, ["fn", "rule"], "left").select("fn", "rule", "effects", F.col("by").alias("accepted_by"))


def positional(violations: DataFrame, edges: DataFrame) -> DataFrame:
    """fn, creators: violations of units named by position that no line can cover, as what creates them doesn't run them;
    creators: callers outside the class and inside the class around it, up to four names."""
    rows = violations.select("fn").distinct().filter(F.col("fn").rlike(r"\$\d") & ~F.col("fn").rlike(_LAMBDA))
    cls = N.module_of(F.col("fn"))
    outer = F.regexp_replace(cls, r"\$\d+\w*$", "")
    inside = lambda c, p: F.startswith(c, F.concat(p, F.lit("."))) | F.startswith(c, F.concat(p, F.lit("$")))
    by = rows.join(edges.select(F.col("callee").alias("fn"), "caller"), "fn").filter(~inside(F.col("caller"), cls) & inside(F.col("caller"), outer))
    by = by.groupBy("fn").agg(F.slice(F.array_sort(F.collect_set("caller")), 1, 4).alias("creators"))
    return rows.join(by, "fn", "left").select("fn", F.coalesce("creators", F.array().cast("array<string>")).alias("creators"))


def refreshed(violations: DataFrame, rules: list[P.Rule], because: str | None = None) -> DataFrame:
    """action, fn, rule, line: the accept lines of a policy brought up to date with its violations (rule, fn, effects).

    remove: nothing is left to accept; narrow: fewer effects than the line accepts; keep; review: more than it accepts.
    With a reason, add: a line for every violation that has none.
    """
    spark = violations.sparkSession
    lines = [(r.fn, r.rule, ",".join(sorted(r.effects)), r.because, r.text) for r in rules if r.kind == "accept"]
    accepts = F.broadcast(spark.createDataFrame(lines, "fn string, rule string, accepted string, because string, text string"))  # lines of a file
    both = accepts.join(violations.select("fn", "rule", "effects"), ["fn", "rule"], "left")
    more = F.size(F.array_except(F.split("effects", ","), F.split("accepted", ","))) > 0
    action = F.when(F.col("effects").isNull(), "remove").when(more, "review").when(F.col("effects") == F.col("accepted"), "keep").otherwise("narrow")
    line = lambda why: F.concat(F.lit("accept "), "fn", F.lit(" "), F.replace("effects", F.lit(","), F.lit(" ")), F.lit(" for "), "rule", F.lit(" because "), why)
    out = both.withColumn("action", action).select("action", "fn", "rule", F.when(F.col("action") == "narrow", line(F.col("because"))).otherwise(F.col("text")).alias("line"))
    if because is None:
        return out
    new = violations.select("fn", "rule", "effects").join(accepts.select("fn", "rule"), ["fn", "rule"], "left_anti")
    return out.unionByName(new.select(F.lit("add").alias("action"), "fn", "rule", line(F.lit(because)).alias("line")))


def tainted(direct: DataFrame) -> DataFrame:
    """code, fn, effects: advisory rows where an effect acts on an argument that comes from the caller; direct: fn, mask,
    derived."""
    rows = direct.filter("derived").groupBy("fn").agg(F.bit_or("mask").alias("mask")).withColumn("mask", F.col("mask").bitwiseAND(mask_of(EFFECTS[:-1]))).filter("mask <> 0")
    return rows.select(F.lit("AS-EFF-007").alias("code"), "fn", F.array_join(names_of(F.col("mask")), ",").alias("effects"))
