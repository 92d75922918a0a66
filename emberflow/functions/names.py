"""Functions over qualified names, reasons, hosts, commands, paths and tables; all built from Spark's own."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name tokens that make a reach surprising, and those that announce it.
BENIGN = "settings config conf options opts util utils helper helpers model models dto entity format fmt parse get load new default validate valid render view build builder item entry record state context ctx info meta data value node field name key id path kind type status check init setup".split()
EFFECTY = "fetch http https client api sync request req download upload query sql store save persist connect conn socket send recv read write open file fs io net tcp udp dns url host port cmd command shell process proc exec spawn env clock time now rand random log logger trace db".split()
# Hosts of model providers and of telemetry services; subdomains count.
MODEL_HOSTS = "api.openai.com api.anthropic.com generativelanguage.googleapis.com api.mistral.ai api.cohere.ai api.cohere.com api.groq.com api.together.xyz api.perplexity.ai openrouter.ai".split()
TELEMETRY_HOSTS = "sentry.io bugsnag.com rollbar.com segment.io segment.com mixpanel.com amplitude.com google-analytics.com analytics.google.com datadoghq.com datadoghq.eu newrelic.com nr-data.net honeycomb.io logtail.com posthog.com plausible.io usefathom.com heapanalytics.com fullstory.com hotjar.com logrocket.com cloudflareinsights.com".split()
LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1", "[::1]")
BEDROCK = ("bedrock-runtime", "bedrock-agent-runtime")
# Effects that the head of a command implies.
COMMANDS = {
    "Net": "curl wget http ssh scp sftp ftp telnet".split(),
    "Db": "psql mysql sqlite3 mongosh mongo redis-cli cqlsh influx".split(),
}
# Beginnings of a reason and their class; anything else is unresolved.
REASONS = (
    ("reflect", ("reflect", "dynamicmemberlookup")),
    ("native", ("native",)),
    ("indirect", ("callback", "closure", "task-handoff")),
    ("dispatch", ("dispatch", "indy", "ambiguous")),
    ("setup", ("missing-config", "no-tsconfig", "no-node_modules")),
)
REASON_CLASSES = ("dispatch", "indirect", "native", "reflect", "setup", "unresolved")


def leaf(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def module_of(name: Column) -> Column:
    """Everything before the last dot; empty without one."""
    return F.when(F.instr(name, ".") > 0, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise("")


def simple_method(name: Column) -> Column:
    return F.substring_index(F.substring_index(name, "(", 1), ".", -1)


def declaring_type(name: Column) -> Column:
    """The name without descriptor and last segment; the whole name if it has one segment."""
    return F.regexp_replace(F.substring_index(name, "(", 1), r"\.[^.]*$", "")


def tokens(name: Column) -> Column:
    """Lower-case tokens, cut at _ . : and where an upper-case letter follows a lower-case one or a digit."""
    marked = F.regexp_replace(name, r"(?<=[\p{Ll}0-9])(?=\p{Lu})", "_")
    return F.filter(F.split(F.lower(marked), "[_.:]"), lambda t: t != "")


def has_token(name: Column, lexicon: list[str]) -> Column:
    return F.arrays_overlap(tokens(name), F.array(*map(F.lit, lexicon)))


def is_test(name: Column) -> Column:
    """A segment before the last that is test(s) in any case or ends in Test(s)."""
    return name.rlike(r"(?:^|\.)(?:[tT][eE][sS][tT][sS]?|[^.]*Tests?)\.")


def match_tier(name: Column, query: str) -> Column:
    """3 exact, 2 a suffix after . or $, 1 a part, 0 none; an empty query matches nothing."""
    if not query:
        return F.lit(0)
    return F.when(name == query, 3).when(F.endswith(name, F.lit("." + query)) | F.endswith(name, F.lit("$" + query)), 2).when(F.contains(name, F.lit(query)), 1).otherwise(0)


def segments(name: Column) -> Column:
    """Segments between . : $; separators inside parentheses don't count."""
    return F.filter(F.split(F.regexp_replace(name, r"[.:$]+(?![^()]*\))", "\u0001"), "\u0001"), lambda s: s != "")


def _parts(scope: str) -> list[str]:
    return [p for p in re.split(r"[.:$]+(?![^()]*\))", scope) if p]


def _run(segs: Column, parts: list[str], last) -> Column:
    k = len(parts)
    if not k:
        return F.lit(False)
    spots = F.when(F.size(segs) >= k, F.sequence(F.lit(1), F.size(segs) - k + 1)).otherwise(F.array().cast("array<int>"))
    head = lambda i: F.lit(True) if k == 1 else F.slice(segs, i, k - 1) == F.array(*map(F.lit, parts[:-1]))
    return F.exists(spots, lambda i: head(i) & last(F.element_at(segs, i + (k - 1))))


def scope_matches(segs: Column, scope: str) -> Column:
    """Some run of segments equals the scope's, the last as a prefix unless the scope ends in a separator."""
    if not scope:
        return F.lit(True)
    parts, t = _parts(scope), scope.rstrip()
    exact = t.endswith(("::", "."))
    return _run(segs, parts, (lambda s: s == parts[-1]) if exact else (lambda s: F.startswith(s, F.lit(parts[-1]))))


def scope_permits(segs: Column, scope: str) -> Column:
    """As scope_matches, with whole segments; an empty scope permits nothing."""
    parts = _parts(scope)
    return _run(segs, parts, lambda s: s == parts[-1]) if parts else F.lit(False)


def reason_class(why: Column) -> Column:
    w = F.lower(F.trim(why))
    out = F.when(why.isNull(), "unresolved")
    for name, heads in REASONS:
        test = F.lit(False)
        for h in heads:
            test = test | F.startswith(w, F.lit(h))
        out = out.when(test, name)
    return out.otherwise("unresolved")


def host_part(h: Column) -> Column:
    """Without brackets or a port; an address with more than one colon stays whole."""
    colons = F.length(h) - F.length(F.replace(h, F.lit(":"), F.lit("")))
    return F.when(F.startswith(h, F.lit("[")), F.regexp_replace(h, r"^\[([^\]]*).*$", "$1")).when(colons > 1, h).otherwise(F.substring_index(h, ":", 1))


def is_ipv4(h: Column) -> Column:
    return h.rlike(r"^(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$")


def host_literal(s: Column) -> Column:
    """The authority of a URL, a host with a numeric port, or a bare IPv4 address; else null."""
    h = F.trim(s)
    authority = F.regexp_replace(F.substring_index(F.regexp_replace(h, r"^.*?://", ""), "/", 1), r"^.*@", "")
    url = F.when((F.trim(authority) == "") | F.contains(authority, F.lit(" ")), None).otherwise(authority)
    bare = F.when(h.rlike(r"[ /]"), None).when(F.instr(h, ":") > 1, F.when(h.rlike(r"^[^:]*\.[^:]*:[0-9]+$"), h)).when(is_ipv4(h), h)
    return F.when(s.isNull() | (h == ""), None).when(F.instr(h, "://") > 0, url).otherwise(bare)


def concat_prefix(recipe: Column) -> Column:
    """The text before the first placeholder (sign 1 or 2) of a concatenation; null where nothing is before it."""
    head = F.regexp_extract(recipe, "^([^\u0001\u0002]*)", 1)
    return F.when(head != "", head)


def concat_host(prefix: Column) -> Column:
    """The host of a URL that begins with prefix: only where a slash ends it there; else null."""
    rest = F.regexp_extract(prefix, r"://([^/]*)/", 1)
    authority = F.regexp_replace(rest, r"^.*@", "")
    return F.when((F.instr(prefix, "://") > 0) & (F.trim(authority) != "") & ~authority.rlike("[ \u0001\u0002]"), authority)


def reason_parts(tag: Column) -> Column:
    """prefix and detail of a reason, cut at its first colon; null for a blank one."""
    colon = F.instr(tag, ":")
    return F.when(F.trim(tag) != "", F.struct(F.when(colon > 0, F.substring_index(tag, ":", 1)).otherwise(tag).alias("prefix"), F.when(colon > 0, F.regexp_replace(tag, r"^[^:]*:", "")).otherwise("").alias("detail")))


def reason_tag(prefix: Column, detail: Column) -> Column:
    """A reason of its parts; without a detail the prefix alone."""
    return F.when(detail == "", prefix).otherwise(F.concat(prefix, F.lit(":"), detail))


def reason_filter(tokens: str) -> tuple[str, ...] | None:
    """Reason classes of a list parted by commas; None (no filter) for *; dynamic is all but setup. A wrong one is an
    error."""
    if tokens.strip() == "*":
        return None
    out: list[str] = []
    for t in (t.strip() for t in tokens.split(",")):
        if t != "dynamic" and t not in REASON_CLASSES:
            raise ValueError(f"unknown class {t!r}")
        out += [c for c in REASON_CLASSES if c != "setup"] if t == "dynamic" else [t]
    return tuple(dict.fromkeys(out))


def version_pin(pin: Column, running: Column) -> Column:
    """absent, malformed, undetermined, match or mismatch of a pinned version and the running one."""
    plain = lambda c: F.regexp_replace(F.trim(c), "^[vV]", "")
    full = lambda c: F.when(plain(c).rlike(r"^\d+\.\d+$"), F.concat(plain(c), F.lit(".0"))).when(plain(c).rlike(r"^\d+\.\d+\.\d+$"), plain(c))
    blank = running.isNull() | (F.trim(running) == "") | (running == "unknown")
    return F.when(pin.isNull(), "absent").when(full(pin).isNull(), "malformed").when(blank, "undetermined").when(full(pin) == F.coalesce(full(running), F.trim(running)), "match").otherwise("mismatch")


def _in_hosts(host: Column, hosts: list[str]) -> Column:
    return host.isin(*hosts) | F.exists(F.array(*[F.lit("." + h) for h in hosts]), lambda e: F.endswith(host, e))


def is_model_host(h: Column) -> Column:
    host = F.lower(host_part(h))
    bedrock = F.endswith(host, F.lit(".amazonaws.com")) & F.substring_index(host, ".", 1).isin(*BEDROCK)
    return F.coalesce(F.when(F.endswith(h, F.lit(":11434")), host.isin(*LOCAL_HOSTS)).otherwise(_in_hosts(host, MODEL_HOSTS) | bedrock), F.lit(False))


def destination_class(h: Column, partners: list[str] = ()) -> Column:
    host = F.lower(host_part(h))
    partner = _in_hosts(host, list(partners)) if partners else F.lit(False)
    return F.when(_in_hosts(host, TELEMETRY_HOSTS), "known-telemetry").when(partner | is_model_host(h), "known-partner").otherwise("unknown-host")


def command_base(c: Column) -> Column:
    """The first word's last path part."""
    return F.regexp_extract(F.regexp_extract(F.trim(c), r"^(\S*)", 1), r"([^/\\]*)$", 1)


def command_effects(c: Column) -> Column:
    base = command_base(c)
    return F.when(base.isin(*COMMANDS["Net"]), F.array(F.lit("Net"))).when(base.isin(*COMMANDS["Db"]), F.array(F.lit("Db"))).otherwise(F.array().cast("array<string>"))


def path_covered(allowed: Column, reached: Column) -> Column:
    """By whole components; .. is never covered, and absolute paths only by absolute ones."""
    cut = lambda p: F.filter(F.split(p, r"[/\\]"), lambda x: (x != "") & (x != "."))
    a, r = cut(allowed), cut(reached)
    rooted = lambda p: p.rlike(r"^[/\\]")
    return ~F.array_contains(r, "..") & (rooted(allowed) == rooted(reached)) & (F.size(a) <= F.size(r)) & (F.slice(r, F.lit(1), F.size(a)) == a)


def table_covered(allowed: Column, reached: Column) -> Column:
    a, r = F.lower(allowed), F.lower(reached)
    return F.when(F.endswith(a, F.lit(".*")), F.startswith(r, F.regexp_replace(a, r"\*$", ""))).otherwise(a == r)
