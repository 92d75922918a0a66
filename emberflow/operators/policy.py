"""Policies: a small line language, and rules held against functions as filters, joins and walks.

A policy is a hand-written file, so its rules are read on the driver and become expressions; functions, edges and
literals stay frames.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberflow.functions import names as N
from emberflow.functions.effects import AMBIENT, BIT, EFFECTS, mask_of, names_of
from emberflow.operators.fixpoint import first_found, inner, nearest
from emberflow.plans.runtime import stored

# Destination classes and the effects that an allow rule may name.
DESTINATIONS = ("known-telemetry", "known-partner", "unknown-host")
ALLOWED = ("Db", "Exec", "Fs", "Llm", "Net")


class PolicyError(ValueError):
    """A policy that is refused as a whole."""


@dataclass(frozen=True)
class Rule:
    """One line. kind: deny, pure, allow, forbid, only, accept."""

    kind: str
    text: str
    effects: tuple[str, ...] = ()
    scope: str = ""
    reasons: tuple[str, ...] = ()
    destinations: tuple[str, ...] = ()
    values: tuple[str, ...] = ()
    to: tuple[str, ...] = ()
    fn: str = ""
    rule: str = ""
    because: str = ""
    narrowed: frozenset = field(default_factory=frozenset)


def _classes(inner: str, effect: str, text: str, aliases: dict[str, tuple[str, ...]]) -> tuple[str, ...] | None:
    """What the list of a narrowed effect names; None for all of them, as `*` says. Empty items say nothing."""
    out: list[str] | None = []
    for c in map(str.strip, inner.split(",")):
        if c == "*":
            out = None
        elif not c:
            continue
        elif effect == "Net" and c in DESTINATIONS or effect == "Unknown" and c in N.REASON_CLASSES:
            named: tuple[str, ...] = (c,)
            out = out if out is None else [*out, *named]
        elif effect == "Unknown" and (c == "dynamic" or c in aliases):
            named = tuple(x for x in N.REASON_CLASSES if x != "setup") if c == "dynamic" else aliases[c]
            out = out if out is None else [*out, *named]
        else:
            raise PolicyError(f"unknown {'destination' if effect == 'Net' else 'class'} {c!r} in {text!r}")
    return None if not out else tuple(dict.fromkeys(out))


def _denied(rest: list[str], line: str, aliases: dict[str, tuple[str, ...]]) -> Rule:
    """A deny line: effects, each narrowed or not, and a scope. An effect named several times means all that is named: one
    bare mention means every class, and lists are united."""
    effects, said, i = [], {"Net": [], "Unknown": []}, 0
    while i < len(rest) and (m := re.fullmatch(r"([A-Z][A-Za-z]*)(?:\[(.*)\])?", rest[i])) and m[1] in EFFECTS:
        effects.append(m[1])
        if m[1] in said:
            named = None if m[2] is None else _classes(m[2], m[1], line, aliases)
            said[m[1]] = None if named is None or said[m[1]] is None else [*said[m[1]], *named]
        elif m[2] is not None:
            raise PolicyError(f"{m[1]} can't be narrowed in {line!r}")
        i += 1
    if not effects or len(rest) - i > 1:
        raise PolicyError(f"bad effect or scope in {line!r}")
    reasons, dests = (tuple(dict.fromkeys(said[e] or ())) for e in ("Unknown", "Net"))
    return Rule("deny", line, tuple(dict.fromkeys(effects)), rest[i] if i < len(rest) else "", reasons, dests)


def parse(text: str, aliases: dict[str, tuple[str, ...]] | None = None) -> list[Rule]:
    """Rules of a policy; a bad token or a policy without rules is refused. Lines of unknown kinds are ignored, which
    `ignored_lines` tells. aliases: names for several classes of reasons."""
    rules = []
    for _, line in _lines(text):
        word, *rest = line.split()
        if word == "deny":
            rules.append(_denied(rest, line, aliases or {}))
        elif word == "pure":
            if len(rest) > 1:
                raise PolicyError(f"one scope at most in {line!r}")
            rules.append(Rule("pure", line, EFFECTS[:-1], rest[0] if rest else ""))
        elif word == "allow":
            if not rest or rest[0] not in ALLOWED:
                raise PolicyError(f"bad effect in {line!r}")
            scope, values = ("", rest[1:]) if rest[1:2] != ["in"] else ("".join(rest[2:3]), rest[3:])
            if not values:
                raise PolicyError(f"no values in {line!r}")
            rules.append(Rule("allow", line, (rest[0],), scope, values=tuple(values)))
        elif word in ("forbid", "only"):
            if len(rest) < 3 or rest[1] != "->" or (word == "forbid" and len(rest) != 3):
                raise PolicyError(f"bad arrow in {line!r}")
            rules.append(Rule(word, line, (), rest[0], to=tuple(rest[2:])))
        elif word == "accept":
            m = re.fullmatch(r"accept (\S+) (.+?) for (.+?) because (.+)", " ".join(line.split()))
            if not m or any(e not in EFFECTS for e in m[2].split()):
                raise PolicyError(f"bad accept line {line!r}")
            rules.append(Rule("accept", line, tuple(m[2].split()), fn=m[1], rule=m[3], because=m[4]))
    if not any(r.kind != "accept" for r in rules):
        raise PolicyError("a policy needs a rule")
    texts = {r.text for r in rules}
    if stray := [r for r in rules if r.kind == "accept" and r.rule not in texts]:
        raise PolicyError(f"{stray[0].text!r} names no rule of this policy")
    return rules


KINDS = ("deny", "pure", "allow", "forbid", "only", "accept")


def _lines(text: str) -> list[tuple[int, str]]:
    """Number and words of each line that says something; a mark at the very beginning and comments are left out."""
    cut = [(i, line.split("#", 1)[0].strip()) for i, line in enumerate(text.removeprefix("\ufeff").splitlines(), 1)]
    return [(i, line) for i, line in cut if line]


def ignored_lines(spark, text: str) -> DataFrame:
    """line, text, reason: lines of no known kind, which no rule comes from."""
    rows = [(i, line, f"unknown rule {line.split()[0]!r}") for i, line in _lines(text) if line.split()[0] not in KINDS]
    return spark.createDataFrame(rows, "line int, text string, reason string")


def unhonoured(spark, text: str) -> DataFrame:
    """rule, why: of a policy that is refused, every rule, as none is evaluated; the bad one says why. Empty for others."""
    try:
        parse(text)
        return spark.createDataFrame([], "rule string, why string")
    except PolicyError as e:
        rows = [(line, str(e) if repr(line) in str(e) else "a rule elsewhere in this policy is refused, and a policy counts as a whole") for _, line in _lines(text) if line.split()[0] != "accept"]
        return spark.createDataFrame(rows, "rule string, why string")


def denied(functions: DataFrame, rules: list[Rule]) -> DataFrame:
    """code, rule, fn, effects of deny and pure rules: one row a rule and function. Synthetic rows (functions with a true
    interface_union, where there is such a column) are disclosed elsewhere and never judged.

    functions: fn, mask, and reasons and destinations (arrays) where a rule narrows. A narrowed effect counts only if
    the function's classes meet the rule's.
    """
    rules = [r for r in rules if r.kind in ("deny", "pure")]
    if not rules:
        return functions.select(F.lit("AS-EFF-006").alias("code"), F.lit("").alias("rule"), "fn", F.lit("").alias("effects")).limit(0)
    if "interface_union" in functions.columns:
        functions = functions.filter(~F.coalesce("interface_union", F.lit(False)))
    segs = N.segments(F.col("fn"))

    def hit(r: Rule) -> Column:
        mask = F.col("mask").bitwiseAND(mask_of(r.effects))
        if r.reasons:
            mask = F.when(F.arrays_overlap("reasons", F.array(*map(F.lit, r.reasons))), mask).otherwise(mask.bitwiseAND(~BIT["Unknown"]))
        if r.destinations:
            mask = F.when(F.arrays_overlap("destinations", F.array(*map(F.lit, r.destinations))), mask).otherwise(mask.bitwiseAND(~BIT["Net"]))
        return F.struct(F.lit(r.text).alias("rule"), F.when(N.scope_matches(F.col("_segs"), r.scope), mask).otherwise(0).alias("mask"))

    rows = functions.withColumn("_segs", segs).withColumn("_hit", F.explode(F.array(*map(hit, rules)))).filter("_hit.mask <> 0")
    return rows.select(F.lit("AS-EFF-006").alias("code"), F.col("_hit.rule").alias("rule"), "fn", F.array_join(names_of(F.col("_hit.mask")), ",").alias("effects"))


def outside_allowlist(functions: DataFrame, literals: DataFrame, rules: list[Rule], incomplete: DataFrame | None = None) -> DataFrame:
    """code, rule, fn, effects, reached: functions with an effect whose literals an allow rule does not all cover.

    literals: fn, effect, value (already closed over calls). Without literals, or with an incomplete surface
    (incomplete: fn, effect), a function can't be certified and is a violation with nothing reached.
    """
    cover = {"Db": N.table_covered, "Fs": N.path_covered, "Exec": lambda a, v: a == N.command_base(v), "Net": lambda a, v: N.host_part(a) == N.host_part(v), "Llm": lambda a, v: N.host_part(a) == N.host_part(v)}
    out = _none(functions, "code string, rule string, fn string, effects string, reached string")
    for r in (r for r in rules if r.kind == "allow"):
        effect = r.effects[0]
        mine = functions.filter((F.col("mask").bitwiseAND(BIT[effect]) != 0) & N.scope_matches(N.segments(F.col("fn")), r.scope)).select("fn")
        covered = F.lit(False)
        for v in r.values:
            covered = covered | cover[effect](F.lit(v), F.col("value"))
        seen = literals.filter(F.col("effect") == effect).groupBy("fn").agg(F.count("value").alias("n"), F.array_sort(F.collect_set(F.when(~covered, F.col("value")))).alias("bad"))
        rows = mine.join(seen, "fn", "left")
        open_ = F.coalesce(F.col("n"), F.lit(0)) == 0
        if incomplete is not None:
            rows = rows.join(incomplete.filter(F.col("effect") == effect).select("fn", F.lit(True).alias("_open")).distinct(), "fn", "left")
            open_ = open_ | F.col("_open").isNotNull()
        rows = rows.withColumn("_o", open_).filter("_o or size(bad) > 0")
        rows = rows.select(F.lit("AS-EFF-008").alias("code"), F.lit(r.text).alias("rule"), "fn", F.lit(effect).alias("effects"), F.when(F.col("_o"), "").otherwise(F.array_join("bad", ",")).alias("reached"))
        out = out.unionByName(rows)
    return out


def _none(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def forbidden(functions: DataFrame, edges: DataFrame, rules: list[Rule], core: DataFrame | None = None) -> DataFrame:
    """code, rule, fn, reached, hops: for forbid A -> B the nearest function in B that one in A reaches.

    The start is tested only if it is reached again; ties go to the first callee by name, step for step. One walk
    serves all rules, over calls of functions that are called (core, where it is known already).
    """
    rules = [r for r in rules if r.kind == "forbid"]
    if not rules:
        return _none(functions, _REACHED)
    segs = N.segments(F.col("fn"))
    within = lambda scope: functions.select("fn", F.explode(F.array_compact(F.array(*[F.when(N.scope_matches(segs, scope(r)), F.lit(r.text)) for r in rules]))).alias("rule"))
    return _told("AS-EFF-009", first_found(edges, stored(nearest(inner(edges) if core is None else core, within(lambda r: r.to[0]))), within(lambda r: r.scope)))


def unpermitted(functions: DataFrame, edges: DataFrame, rules: list[Rule]) -> DataFrame:
    """code, rule, fn, reached, hops: for only A -> B C the first reach of A that is neither in A nor permitted.

    Permitted functions aren't passed; those in A's scope are; the walk stops at others. One walk serves all rules: a
    rule passes a call only if its caller is in scope and not permitted.
    """
    rules = [r for r in rules if r.kind == "only"]
    if not rules:
        return _none(functions, _REACHED)
    # Split once and dealt evenly: names may come in few files, and each is held against all rules.
    functions, segs = functions.select("fn", N.segments(F.col("fn")).alias("_segs")).repartition("fn"), F.col("_segs")

    def permitted(r: Rule) -> Column:
        out = F.lit(False)
        for to in r.to:
            out = out | N.scope_permits(segs, to)
        return out

    which = lambda test: F.array_compact(F.array(*[F.when(test(r), F.lit(r.text)) for r in rules]))
    own = lambda r: N.scope_matches(segs, r.scope)
    marked = stored(functions.select("fn", which(own).alias("own"), which(lambda r: own(r) & ~permitted(r)).alias("passed"), which(lambda r: ~own(r) & ~permitted(r)).alias("ends")))
    own_calls = stored(edges.join(marked.filter("size(own) > 0").select(F.col("fn").alias("caller"), "passed"), "caller"))
    # An end that nobody in scope calls is no end of a walk.
    ends = marked.join(own_calls.select(F.col("callee").alias("fn")).distinct(), "fn", "left_semi").select("fn", F.explode("ends").alias("rule"))
    near = nearest(own_calls.filter("size(passed) > 0"), ends, F.array_contains("passed", F.col("rule")))
    return _told("AS-EFF-011", first_found(own_calls, near, marked.select("fn", F.explode("own").alias("rule"))))


_REACHED = "code string, rule string, fn string, reached string, hops long"


def _told(code: str, found: DataFrame) -> DataFrame:
    return found.select(F.lit(code).alias("code"), "rule", "fn", F.col("found").alias("reached"), F.col("hops").cast("long").alias("hops"))


def judge_accepts(violations: DataFrame, rules: list[Rule], unevaluated: DataFrame | None = None, twins: DataFrame | None = None) -> DataFrame:
    """status, fn, rule, effects, outside: accept lines against violations (rule, fn, effects joined by commas).

    accepted if the violation's effects are all named, exceeded if some aren't, stale without such a violation; unjudged
    if its rule wasn't evaluated (unevaluated: rule), ambiguous if two units have the name (twins: fn).
    """
    spark = violations.sparkSession
    lines = [(r.fn, r.rule, ",".join(sorted(r.effects))) for r in rules if r.kind == "accept"]
    accepts = F.broadcast(spark.createDataFrame(lines, "fn string, rule string, accepted string"))  # lines of a file
    both = accepts.join(violations.select("fn", "rule", "effects"), ["fn", "rule"], "left")
    outside = F.array_except(F.split("effects", ","), F.split("accepted", ","))
    status = F.when(F.col("effects").isNull(), "stale").when(F.size(outside) == 0, "accepted").otherwise("exceeded")
    if twins is not None:
        both = both.join(twins.select("fn", F.lit(True).alias("_twin")), "fn", "left")
        status = F.when(F.col("_twin"), "ambiguous").otherwise(status)
    if unevaluated is not None:
        both = both.join(unevaluated.select("rule", F.lit(True).alias("_open")).distinct(), "rule", "left")
        status = F.when(F.col("_open"), "unjudged").otherwise(status)
    return both.select(status.alias("status"), "fn", "rule", F.coalesce("effects", F.lit("")).alias("effects"), F.coalesce(F.array_join(outside, ","), F.lit("")).alias("outside"))


def ambient(direct: DataFrame) -> DataFrame:
    """code, fn, effects: what functions perform themselves of all effects but Log and Unknown."""
    mask = F.col("mask").bitwiseAND(mask_of(AMBIENT))
    return direct.filter(mask != 0).select(F.lit("AS-EFF-004").alias("code"), "fn", F.array_join(names_of(mask), ",").alias("effects"))


def zero_match(functions: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule, n: how many functions each rule's scope selects, rules that select none included."""
    segs = functions.select(N.segments(F.col("fn")).alias("s"))
    some = [r for r in rules if r.kind != "accept"]
    if not some:
        return _none(functions, "rule string, n long")
    sums = segs.agg(*[F.count(F.when(N.scope_matches(F.col("s"), r.scope), 1)).alias(f"r{i}") for i, r in enumerate(some)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(r.text).alias("rule"), F.col(f"r{i}").alias("n")) for i, r in enumerate(some)])).alias("x")).select("x.rule", "x.n")


def verdict(n_violations: int, unevaluated: int = 0, incomplete: bool = False) -> int:
    """Exit code: a violation 1, before anything not evaluated or incomplete 2, else 0."""
    return 1 if n_violations else 2 if unevaluated or incomplete else 0
