"""Personal data: fixed patterns, and spans added by boosted trees over candidates.

Base spans (email, ip, card, phone) follow fixed rules and always stay. High-recall generators propose further,
overlapping spans: the same data with its signs spelt out, spaced, swapped or left out. Boosted trees score them by
format and context. They learn from base spans of the corpus rewritten in such forms, in their own contexts (true),
from the same with a digit or a name that no longer fits (false), and from the candidates that the corpus holds itself.
Nobody has judged these, and some may be true, so they count as unlabelled: a score says how much likelier a candidate
is among the rewritten than among the corpus's own, whatever the true ones' share in these. That share is estimated from
the scores, and a kind's threshold is the least from which `precision` of the corpus's own are true by that estimate, and
of rewritten against spoilt ones as many.

Each kind has trees of its own, learnt from every candidate of every document. Features are small whole numbers, so
candidates that fall into the same bins are one cell with a count, and a level of all trees is split by sums over cells
(`boosting`). Thresholds are from counts of all candidates by score, each scored by trees of other documents. Finding
takes every document whole. Cases: a null text is the empty one, without spans; every kind also learns from `WRITTEN`
made-up spans, so one that the corpus hardly holds or lacks is found by the same rule; ties go to the earlier, then longer span; an empty table gives no rows; columns of
docs that a redaction doesn't change pass through.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberflow.llm.boosting import BLOCKS, RATE, Block, Boosted, block_row, boosted_over, cuts_of, grown
from emberflow.llm.common import key_text, parts, ready, small, stored, text_of

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that fails from its first digit fails from the others, so starts inside a run are left out.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: High recall: the sign of an address, also spelt out, and what may stand on its sides; digits with separators.
_AT = re.compile(r"\s?(?:[@\uff20]|[\[({<]\s?(?:at|AT|@)\s?[\])}>]|(?<=\w)\sat\s(?=\w))\s?")
_LEFT = re.compile(r"[\w.+%-]{1,64}$")
_RIGHT = re.compile(r"[\w-]{1,63}(?:\s?(?:\.|\uff0e|[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]|(?<=\w)\sdot\s(?=\w))\s?[\w-]{1,63}){1,5}")
_GENERATORS = (
    ("ip", re.compile(r"(?<![0-9.,])[0-9]{1,3}(?: ?(?:[.,:]|\[\.\]|\(\.\)| dot ) ?[0-9]{1,3}){3}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9](?:[ ./_-]{0,3}[0-9]){11,22}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])(?:\+ ?)?\(?[0-9](?:[ ()./-]{0,3}[0-9]){5,17}(?![0-9])")),
)
#: Made-up spans a kind, and the features that tell whether the digits and names fit a kind.
WRITTEN = 150


def luhn(digits: str) -> bool:
    """Luhn's sum is a multiple of ten."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: a local part begins at the earliest sign of its run."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    out = [("email", s, e) for s, e in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping spans, each kind and place once."""
    found = set()
    for m in _AT.finditer(text):
        left, right = _LEFT.search(text, max(0, m.start() - 64), m.start()), _RIGHT.match(text, m.end())
        if left and right:
            found.add(("email", left.start(), right.end()))
    if _DIGIT.search(text):
        found |= {(k, m.start(), m.end()) for k, p in _GENERATORS for m in p.finditer(text)}
    return sorted(found)


_LABEL = re.compile(r"(?i)(mail|tel|phone|call|fax|mobile|contact|card|visa|account|credit|iban|host|server|address|ip)\W*$")


def fits(s: str, kind: str) -> bool:
    """The digits or names of a span are possible ones for its kind, whatever stands between them."""
    runs = re.findall(r"[0-9]+", s)
    digits = "".join(runs)
    if kind == "email":
        return bool(re.search(r"[A-Za-z]{2,}$", s))
    if kind == "ip":
        return len(runs) == 4 and all(int(r) <= 255 for r in runs)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def format_features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    s = text[start:end]
    runs = [len(r) for r in re.findall(r"[0-9]+", s)]
    before, after = text[max(0, start - 24) : start], text[end : end + 2]
    last = re.search(r"[.\s\])}>]([^.\s\])}>]*)$", s)
    side = lambda c: 0.0 if not c else 1.0 if c.isspace() else 2.0 if c.isalnum() else 3.0
    spelt = re.search(r"[\[({<]\s?(?:at|AT|@)|\sat\s", s)
    return [
        float(fits(s, kind)), float(len(s)), float(sum(runs)), float(len(runs)), float(max(runs, default=0)), float(min(runs, default=0)),
        float(s.count(".")), float(s.count(" ")), float(s.count("-")), float(s.count("(")), float(s.startswith("+")), float(s.count("@")),
        float(ord(s[0]) - 48 if s[0] in "0123456789" else -1), float(runs[0] if runs else 0), float(runs[-1] if runs else 0),
        float(sum(c.isalpha() for c in s)), float(len(last[1]) if last else 0), float(bool(re.search(r"[^\w.+%() @-]", s))),
        side(before[-1:]), side(after[:1]), float(bool(_LABEL.search(before))), float(s[-1:].isalnum()), float(bool(re.search(r"[^\x00-\x7f]", s))),
        float(bool(spelt)), float(len(re.findall(r"dot|DOT|\[\.\]|\(\.\)", s))), float(s.startswith("00")), float(sum(c in "/_:," for c in s)),
    ]


def rewritten(s: str, kind: str, rng: random.Random) -> str:
    """A base span in another form: signs spelt out, spaced, swapped or left out."""
    if kind == "email":
        name, host = s.split("@", 1)
        at, dot = rng.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), ("[at]", "."), (" @ ", "."), ("\uff20", "."), (" at ", " dot "), ("@", " . "), ("@", "[.]"), (" AT ".lower(), ".")])
        return name + at + host.replace(".", dot)
    if kind == "ip":
        return s.replace(".", rng.choice([" . ", "[.]", "(.)", ",", " dot ", ". ", ":"]))
    digits = re.sub(r"[^0-9]", "", s)
    if kind == "card":
        sep = rng.choice([".", "/", "_", "  ", " - ", ". "])
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    inner = re.sub(r"[^0-9]+", rng.choice([".", "/", " ", "-", ". "]), s.strip("+")).strip("./ -")
    plain = s.strip("+ ")
    return rng.choice([inner, plain, f"00{inner}", f"00 {plain}", f"+ {inner}", f"({digits[:3]}) {inner[3:].strip('./ -')}"])


def spoilt(s: str, kind: str, rng: random.Random) -> str:
    """A base span whose digits or names no longer fit its kind."""
    if kind == "email":
        return s[: s.rindex(".") + 1] + str(rng.randint(1, 99))
    if kind == "ip":
        parts_ = s.split(".")
        parts_[rng.randrange(4)] = str(rng.randint(256, 999))
        return ".".join(parts_)
    if kind == "card":
        return s[:-1] + str((int(s[-1]) + rng.randint(1, 9)) % 10)
    digits = re.sub(r"[^0-9]", "", s)
    return "+" + (digits[: rng.randint(6, 8)] if rng.random() < 0.5 else (digits * 2)[: rng.randint(16, 18)])


def lessons(text: str, span: tuple[str, int, int], rng: random.Random) -> list[tuple[int, list[float]]]:
    """Features of a base span rewritten in its context (1) and of a spoilt one rewritten likewise (2)."""
    kind, start, end = span
    before, after, out = text[max(0, start - 40) : start], text[end : end + 40], []
    for mark, made in ((1, text[start:end]), (1, text[start:end]), (2, spoilt(text[start:end], kind, rng))):
        s = rewritten(made, kind, rng)
        whole, want = before + s + after, (kind, len(before), len(before) + len(s))
        if want in candidates(whole) and want not in base_spans(whole):
            out.append((mark, format_features(whole, *want)))
    return out


def written(kind: str, n: int = WRITTEN) -> list[tuple[int, list[float]]]:
    """Lessons from n made-up base spans of a kind, always the same."""
    rng = random.Random(kind)
    some = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    labels = {"email": "mail", "ip": "host", "card": "card", "phone": "call"}
    out: list[tuple[int, list[float]]] = []
    for _ in range(n):
        if kind == "email":
            s = rng.choice([f"{word()}.{word()}", word(), f"{word()}{some(2)}"]) + f"@{word()}." + rng.choice(["com", "org", "example.net"])
        elif kind == "ip":
            s = ".".join(str(rng.randint(1, 255)) for _ in range(4))
        elif kind == "card":
            digits = rng.choice("3456") + some(14)
            digits += next(c for c in "0123456789" if luhn(digits + c))
            s = rng.choice(["", " ", "-"]).join(digits[i : i + 4] for i in range(0, 16, 4))
        else:
            s = rng.choice([f"+1 ({some(3)}) {some(3)}-{some(4)}", f"+1-{some(3)}-{some(3)}-{some(4)}", f"+{rng.randint(30, 99)} {some(2)} {some(4)} {some(4)}", f"+{rng.randint(30, 99)}{some(9)}"])
        before = f"{word()} {rng.choice([labels[kind], word()])} "
        text, span = f"{before}{s} {word()} {word()}", (kind, len(before), len(before) + len(s))
        if span in base_spans(text):
            out += lessons(text, span, rng)
    return out


@dataclass
class Finder:
    """For each kind its trees and the threshold from which a candidate is added."""

    trees: dict[str, Boosted]
    thresholds: dict[str, float]

    def chances(self, text: str, found: list[tuple[str, int, int]]) -> np.ndarray:
        """Scores of candidates."""
        x, kind, p = np.array([format_features(text, *c) for c in found], np.float32), np.array([c[0] for c in found]), np.zeros(len(found))
        for k in np.unique(kind):
            p[kind == k] = self.trees[k].chance(x[kind == k])
        return p

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Candidates at or above their kind's threshold, beside the base spans, the likeliest of overlapping ones."""
        if not (found := [c for c in candidates(text) if c[0] in self.trees and not any(c[1] < e and s < c[2] for _, s, e in base)]):
            return []
        p = self.chances(text, found)
        out: list[tuple[str, int, int]] = []
        sure = [i for i, c in enumerate(found) if p[i] >= self.thresholds[c[0]]]
        for i in sorted(sure, key=lambda i: (-p[i], found[i][1], -found[i][2])):
            if not any(found[i][1] < e and s < found[i][2] for _, s, e in out):
                out.append(found[i])
        return out

    def find(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans and all spans, in order of kind as listed and start."""
        base = base_spans(text)
        return base, sorted([*base, *self.added(text, base)], key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def _above(score: np.ndarray, weight: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The weight of scores at or above each cut."""
    order = np.argsort(score)
    return np.concatenate([np.cumsum(weight[order][::-1])[::-1], [0.0]])[np.searchsorted(score[order], cuts)]


def share_of(natural: np.ndarray, weight: np.ndarray, true: np.ndarray, of_true: np.ndarray | None = None) -> float:
    """The share of the corpus's own candidates that may be like rewritten true ones: from any score on they hold about
    that share of the rewritten ones' part there, so the least such ratio bounds it. Scores that most of the rewritten
    reach are looked at, as those written in their own contexts score somewhat higher than strange ones; a count of k is
    taken as k + 2 sqrt(k) + 2, the most that chance would make of it. weight, of_true: how many have each score."""
    of_true = np.ones(len(true)) if of_true is None else of_true
    if not of_true.sum() or not weight.sum():
        return 0.0
    order = np.argsort(true)
    fifth = true[order][np.searchsorted(np.cumsum(of_true[order]), 0.2 * of_true.sum())]
    cuts = np.unique(true[true <= fifth])
    above = _above(natural, weight, cuts)
    above = above + 2 * np.sqrt(above) + 2
    return float(min(1.0, (above / weight.sum() / (_above(true, of_true, cuts) / of_true.sum())).min()))


def threshold_of(natural: np.ndarray, weight: np.ndarray, true: np.ndarray, false: np.ndarray, precision: float, of_true: np.ndarray | None = None, of_false: np.ndarray | None = None) -> float:
    """The least score from 0.5 from which on, by estimate, `precision` of the corpus's own candidates are true, and of
    rewritten ones (true and spoilt) as many. weight, of_true, of_false: how many have each score.

    Nobody has judged the corpus's own candidates. Of those above a score, true ones are as many as their share of all
    (`share_of`) and the rewritten ones' part above it say. At 0.5 a candidate is as likely among the rewritten as among
    the corpus's own, however many of these are true, so nothing below is taken.
    """
    of_true, of_false = (np.ones(len(x)) if n is None else n for x, n in ((true, of_true), (false, of_false)))
    total, share, n = max(weight.sum(), 1e-9), share_of(natural, weight, true, of_true), max(1, of_true.sum())
    cuts = np.unique(np.append(true[true >= 0.5], 0.5))
    yes, no, own = _above(true, of_true, cuts), _above(false, of_false, cuts), _above(natural, weight, cuts) / total
    good = (yes > 0) & (yes >= precision * (yes + no)) & (share * yes / n >= precision * own)
    return float(cuts[good][0]) if good.any() else 2.0


#: Parts of the documents that take turns in being scored by trees of the others, and steps of these scores.
FOLDS, STEPS = 4, 10_000
_CELL = "kind int, mark int, fold int, x binary, n long"
_COUNTS = [f"n{i}" for i in range(FOLDS)]


def _cells(counts: dict[tuple[int, int, int, bytes], int]) -> pa.RecordBatch:
    kind, mark, fold, x = zip(*counts) if counts else [()] * 4
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in (kind, mark, fold)], pa.array(x, pa.binary()), pa.array(list(counts.values()), pa.int64())], ["kind", "mark", "fold", "x", "n"])


def lessons_of(docs: DataFrame) -> DataFrame:
    """kind, mark (0: the corpus's own, 1: rewritten, 2: spoilt), x (features, as 16-bit integers) of every candidate of
    every document and of those made up, and how many of them are in each fold."""
    rows = docs.select(F.concat(key_text(), F.lit(":"), F.md5(text_of())).alias("key"), text_of().alias("text"))
    rows = rows.filter(F.col("text").rlike("[0-9@\uff20]|(?i)\\bat\\b"))
    whole = lambda f: np.array(f, "<i2").tobytes()

    def propose(batches):
        seen: Counter = Counter()
        for b in small(batches):
            for key, text in zip(b["key"].to_pylist(), b["text"].to_pylist()):
                base, rng, fold = base_spans(text), random.Random(key), zlib.crc32(key.encode()) % FOLDS
                for c in candidates(text):
                    if not any(c[1] < e and s < c[2] for _, s, e in base):
                        seen[KINDS.index(c[0]), 0, fold, whole(format_features(text, *c))] += 1
                for span in base:
                    seen.update((KINDS.index(span[0]), m, fold, whole(f)) for m, f in lessons(text, span, rng))
            if len(seen) > 1 << 15:
                yield _cells(seen)
                seen.clear()
        yield _cells(seen)

    def make(batches):
        for b in batches:
            for k in b["id"].to_pylist():
                yield _cells(Counter((k, m, i % FOLDS, whole(f)) for i, (m, f) in enumerate(written(KINDS[k]))))

    made = docs.sparkSession.range(0, len(KINDS), 1, len(KINDS)).mapInArrow(make, _CELL)
    some = rows.mapInArrow(propose, _CELL).unionByName(made)
    return some.groupBy("kind", "mark", "x").agg(*[F.sum(F.when(F.col("fold") == i, F.col("n")).otherwise(0)).alias(c) for i, c in enumerate(_COUNTS)])


def fit(docs: DataFrame, max_docs: int | None = None, precision: float = 0.98, each: int = 50_000) -> Finder:
    """A finder learnt from all docs. Up to `each` cells of a kind (candidates that no bin tells apart) are worked on at
    once, more in parts; max_docs bounded the documents that were learnt from and has no effect any more."""
    spark = ready(docs.sparkSession)
    n_features = len(format_features("0", "card", 0, 1))
    raw = stored(lessons_of(docs))

    def told(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b["x"].to_pylist()), "<i2").reshape(-1, n_features)
            n, kind, side = sum(b[c].to_numpy() for c in _COUNTS), b["kind"].to_numpy(), (b["mark"].to_numpy() == 1).astype(np.int64)
            f = np.arange(n_features)
            every = np.stack([np.broadcast_to(v, x.shape).ravel() for v in (kind[:, None], side[:, None], f, x)])
            some, at = np.unique(every, axis=1, return_inverse=True)
            yield pa.RecordBatch.from_arrays([*[pa.array(v, pa.int32()) for v in some], pa.array(np.bincount(at.ravel(), np.repeat(n, n_features)).astype(np.int64))], ["kind", "side", "f", "v", "n"])

    # Features are short lengths and counts, so distinct values are at most some hundreds a feature.
    held = raw.mapInArrow(told, "kind int, side int, f int, v int, n long").groupBy("kind", "side", "f", "v").agg(F.sum("n").alias("n")).toArrow()
    kind, side, feature, value, n = (held[c].to_numpy() for c in ("kind", "side", "f", "v", "n"))
    cuts: list[list[np.ndarray]] = []
    for k in range(len(KINDS)):
        cuts.append([])
        for j in range(n_features):
            mine = (kind == k) & (feature == j)
            # True ones and the others weigh the same, so rare values of a side are told apart as well.
            weight = sum((mine & (side == s)) * n / max(1, n[mine & (side == s)].sum()) for s in (0, 1))
            some, at = np.unique(value[mine], return_inverse=True)
            cuts[k].append(cuts_of(some, np.bincount(at, weight[mine])))
    shared = spark.sparkContext.broadcast(cuts)

    def bins(batches):
        for b in batches:
            x, kind = np.frombuffer(b"".join(b["x"].to_pylist()), "<i2").reshape(-1, n_features), b["kind"].to_numpy()
            out = np.zeros(x.shape, np.uint8)
            for k in np.unique(kind):
                out[kind == k] = Boosted(shared.value[k], 0.0, RATE).binned(x[kind == k])
            yield pa.RecordBatch.from_arrays([b["kind"], b["mark"], pa.array([r.tobytes() for r in out], pa.binary()), *[b[c] for c in _COUNTS]], ["kind", "mark", "b", *_COUNTS])

    cells = raw.mapInArrow(bins, "kind int, mark int, b binary, " + ", ".join(f"{c} long" for c in _COUNTS))
    cells = stored(cells.groupBy("kind", "mark", "b").agg(*[F.sum(c).alias(c) for c in _COUNTS]))
    sizes = cells.groupBy("kind", (F.col("mark") == 1).alias("true")).agg(F.count("*").alias("cells"), *[F.sum(c).alias(c) for c in _COUNTS]).collect()  # at most 8 rows
    # Models of a kind: one without each fold, and one of all.
    uses = np.concatenate([1 - np.eye(FOLDS), np.ones((1, FOLDS))])
    totals = np.zeros((len(KINDS), 2, FOLDS + 1))
    for r in sizes:
        totals[r["kind"], int(r["true"])] = uses @ [r[c] for c in _COUNTS]
    # Rewritten ones against spoilt ones and all that the corpus has, true or not, each side weighing the same: a score
    # above one half says that a candidate is likelier among the rewritten, whatever share of the corpus's own is true.
    even = totals.sum(1, keepdims=True) / 2 / np.maximum(totals, 1)
    cut = max([parts(sum(r["cells"] for r in sizes if r["kind"] == k), each) for k in range(len(KINDS))])

    def block(rows: pa.Table) -> Block:
        y, k = (rows["mark"].to_numpy() == 1).astype(float), rows["kind"][0].as_py()
        n = np.stack([rows[c].to_numpy() for c in _COUNTS], 1) @ uses.T
        b = np.frombuffer(b"".join(rows["b"].to_pylist()), np.uint8).reshape(len(y), n_features)
        return Block(b, y, n, n * even[k][y.astype(int)], np.zeros(n.shape))

    if cut == 1:

        def train(rows: pa.Table) -> pa.Table:
            return pa.table({"kind": rows["kind"][:1], "trees": pa.array([json.dumps(grown(block(rows)))])})

        told_trees = lambda text: [[[tuple(node) for node in nodes] for nodes in some] for some in json.loads(text)]
        every = {r["kind"]: told_trees(r["trees"]) for r in cells.repartition(len(KINDS), "kind").groupBy("kind").applyInArrow(train, "kind int, trees string").collect()}
    else:

        def pack(rows: pa.Table) -> pa.Table:
            return pa.Table.from_pylist([block_row(block(rows), rows["kind"][0].as_py() * len(uses))], pa.schema([("first", pa.int32()), ("models", pa.int32()), *[(c, pa.binary()) for c in "bynwz"]]))

        blocks = stored(cells.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(cut))).groupBy("kind", "part").applyInArrow(pack, BLOCKS))
        grew = boosted_over(blocks, len(KINDS) * len(uses))
        every = {k: grew[k * len(uses) : (k + 1) * len(uses)] for k in range(len(KINDS))}
    models = {k: [Boosted(cuts[k], 0.0, RATE, t) for t in trees] for k, trees in every.items()}
    learnt = spark.sparkContext.broadcast(models)  # a fixed number of trees

    def scores(batches):
        for b in batches:
            kind, x = b["kind"].to_numpy(), np.frombuffer(b"".join(b["b"].to_pylist()), np.uint8).reshape(-1, n_features)
            for k in np.unique(kind):
                mine = kind == k
                for i, c in enumerate(_COUNTS):
                    p = 1 / (1 + np.exp(-learnt.value[k][i].margin_binned(x[mine])))
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (kind[mine], b["mark"].to_numpy()[mine], np.floor(p * STEPS).astype(np.int32), b[c].to_numpy()[mine])], ["kind", "mark", "p", "n"])

    # At most STEPS + 1 rows a kind and mark, each with the number of all candidates of that score.
    held = cells.mapInArrow(scores, "kind int, mark int, p int, n long").groupBy("kind", "mark", "p").agg(F.sum("n").alias("n")).filter("n > 0").toArrow()
    kind, mark, p, n = (held[c].to_numpy() for c in ("kind", "mark", "p", "n"))
    thresholds = {}
    for k, name in enumerate(KINDS):
        own, true, false = ((p[(kind == k) & (mark == m)] / STEPS, n[(kind == k) & (mark == m)].astype(float)) for m in range(3))
        thresholds[name] = threshold_of(*own, true[0], false[0], precision, true[1], false[1])
    return Finder({name: models[k][-1] for k, name in enumerate(KINDS)}, thresholds)


def _told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, finder: Finder) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 of them, all spans, and how many were added."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(finder)  # a fixed number of trees
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]

    def run(batches):
        for b in small(batches):
            rows = []
            for text in b["text"].to_pylist():
                base, spans = shared.value.find(text)
                rows.append((*[sum(x[0] == k for x in base) for k in KINDS], hashlib.sha256(_told(base).encode()).hexdigest(), _told(spans), len(spans) - len(base)))
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *[pa.array(c, t) for c, t in zip(cols, kinds)]], names)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, finder: Finder) -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; overlapping spans are replaced as one. A
    column n_chars, where there is one, follows the new text."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(finder)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for kind, s, e in sorted(shared.value.find(text)[1], key=lambda x: (x[1], -x[2])):
            if s >= at:
                out += [text[at:s], f"[{kind.upper()}]"]
            at = max(at, e)
        return "".join([*out, text[at:]])

    def run(batches):
        for b in small(batches):
            i = b.schema.get_field_index("text")
            yield b.set_column(i, b.schema.field(i), pa.array([clean(t) for t in b["text"].to_pylist()], b.schema.field(i).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast(kind)))
