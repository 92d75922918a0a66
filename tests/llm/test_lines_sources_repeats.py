"""Fill-in-the-middle, divergence of sources and repeated passages, each against a plain version."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberflow.llm import divergence, middle, suffixes


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# Fill in the middle


def plain_middle(doc_id, text, seed=7, rate=100, spm_rate=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(units)
    if not text or any(s in text for s in middle.SENTINELS) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, m, z = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    return doc_id, n, form, len(a), len(m), f"<S>{z}<P>{a}<M>{m}" if form == "spm" else f"<P>{a}<S>{z}<M>{m}"


@pytest.fixture(scope="module")
def lined(spark):
    rng = random.Random(3)
    pieces = ["\n", "\n\n", "<P", "<", "P>", "S>", "<<", "M>", "é", "日本", "😀", "word ", "\r", "a" * 600, "<P>", "<S>", "<M>"]
    texts = ["".join(rng.choice(pieces[: 14 if i % 3 else 17]) for _ in range(rng.randint(0, 40))) for i in range(300)]
    texts += [None, "", "\n", "no line end", "<", "<P", "<P>", "P>", "<\nP>", "x" * 511 + "<P>", "x" * 510 + "<P>\n", "<<P>", "é" * 70000 + "\n<S" + "y" * 70000]
    rows = list(enumerate(texts)) + [(5, texts[7]), (None, "a\nb\nc")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("own")).withColumn("key", F.lit(1)).repartition(3)


@pytest.mark.parametrize("how", [{}, {"seed": 11, "rate": 40, "spm_rate": 100}])
def test_middle_equals_plain(lined, how):
    out = middle.transform(lined, **how).withColumn("again", middle.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(r)[:6] for r in out) == Counter(plain_middle(*r, **how) for r in rows_of(lined))
    assert Counter((r["doc_id"], r["again"]) for r in out) == Counter(rows_of(lined))
    assert {r["form"] for r in out} == ({"plain", "spm"} if how else {"plain", "spm", "psm"})
    assert middle.transform(lined.limit(0)).count() == 0


def test_automaton_counts_over_lanes():
    data = np.frombuffer(("<P>" * 700 + "é\n<S" + ">" + "<M").encode(), np.uint8)
    flags = middle.scan(data, np.array([0, 2101, len(data)]))
    assert (flags & middle.END_SENTINEL > 0).sum() == 700 + (b"<S>" in data.tobytes())
    assert (flags & middle.CHAR > 0).sum() == len(data) - 1
    # A row that begins inside what would be a sentinel doesn't see it.
    assert (middle.scan(data, np.array([0, 1, len(data)])) & middle.END_SENTINEL > 0).sum() == 700


# Sources


def plain_audit(rows, least, top, prior=5, scale=10**9):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = term.findall((text or "").translate(lower))
        df[lang].update(set(found))
        n[lang, source].update(found)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, c in df[lang].items() if c >= least)
        total = Counter()
        for s in sources:
            total.update({t: n[lang, s][t] for t in kept})

        def shares(c, kept=kept):
            under = sum(c[t] for t in kept) + prior * len(kept)
            return {t: 1 + scale * (c[t] + prior) // under for t in kept}

        p, q = {s: shares(n[lang, s]) for s in sources}, shares(total)
        for s in sources:
            far = sorted(((sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (-x[0], x[1].encode()))
            near = sorted(((p[s][t] - q[t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))[:top]
            for part, items in (("pair", far), ("term", near)):
                out += [(lang, s, part, t, v, i + 1) for i, (v, t) in enumerate(items)]
    return out


@pytest.fixture(scope="module")
def sourced(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("Uno", "dos", "TRÈS", "vier", "ñ") for b in "abcdefghij"]
    rows = []
    for i in range(500):
        source = rng.choice(["a", "b", "é", "z", None, "alone"]) if i % 3 else "hot"
        lang = "xx" if source == "alone" else rng.choice(["en", "fr", None])
        text = rng.choice([" ", "9", "_", "--"]).join(rng.choices(words, [1 + (len(source or "") * k) % 7 for k in range(50)], k=rng.randint(0, 30)))
        rows.append((i, text, lang, source))
    rows += [(900, None, "en", "silent"), (901, "", "none", "s1"), (902, "rare words", "none", "s2"), (3, "x" * 100_000 + " Unoa", "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumn("term", F.lit("own")).withColumn("n", F.lit(0)).withColumn("value", F.lit(0)).repartition(4)


@pytest.mark.parametrize(("least", "top"), [(30, 50), (1, 3)])
def test_audit_equals_plain(sourced, least, top):
    rows = [(r["lang"], r["source"], r["text"]) for r in sourced.collect()]
    got = divergence.audit(sourced, least, top).collect()
    assert Counter(map(tuple, got)) == Counter(plain_audit(rows, least, top))
    assert divergence.audit(sourced.limit(0)).count() == 0


def test_terms_are_runs_of_letters_and_upper_bytes():
    found, row = divergence.terms(pa.array(["Ab9CÉ-d", None, "", "__x", "y"]))
    assert found.to_pylist() == ["ab", "cÉ", "d", "x", "y"] and row.tolist() == [0, 0, 0, 3, 4]


# Repeats


def plain_repeats(rows, length):
    texts = [t.encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        hit, end = bytearray(len(t)), 0
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                at = max(i, end)
                hit[at : i + length] = b"\1" * (i + length - at)
                end = i + length
        kept = bytes(c for c, h in zip(t, hit) if not h)
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(hit))]
        out.append((doc_id, len(t), sum(hit), len(spans), hashlib.sha256(kept).hexdigest(), tuple(spans)))
    return out


@pytest.mark.parametrize(("length", "letters"), [(400, "abcdefgh"), (60, "abcdefgh"), (26, "ab"), (2, "ab")])
def test_repeats_equal_plain(spark, length, letters):
    rng = random.Random(length)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 3 * length))) for _ in range(30)]
    texts = list(base)
    for _ in range(60):
        x = rng.choice(base)
        i = rng.randint(0, len(x))
        texts.append(rng.choice(base)[:length] + x[i : rng.randint(i, len(x))] + rng.choice(base)[length // 3 : 2 * length])
    texts += ["a" * 5 * length, "a" * (length + 1), "a" * length, "ab" * 3 * length, None, "", base[0], base[0], "é" * length + "ü"]
    rows = list(enumerate(texts)) + [(None, base[1]), (3, "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("own")).withColumn("spans", F.lit(1)).repartition(4)
    got = suffixes.remove_repeats(df, length).collect()
    want = Counter(plain_repeats([(i, t or "") for i, t in rows], length))
    assert Counter((*tuple(r)[:5], tuple(map(tuple, r["spans"]))) for r in got) == want
    assert suffixes.remove_repeats(df.limit(0), length).count() == 0


def test_repeats_over_stretches_and_blocks(spark):
    """A text over several stretches, and copies of parts of it at their borders and in other blocks."""
    rng = np.random.default_rng(9)
    long = "".join(map(chr, rng.integers(97, 123, 5_000_000)))
    edge = suffixes.STRETCH
    rows = [(0, long), (1, long[edge - 300 : edge + 300]), (2, long[2 * edge - 399 : 2 * edge]), (3, long[-1000:] + "#"), (4, "#" + long[4_300_000:4_300_400])]
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in got[0]["spans"]] == [(edge - 300, edge + 300), (4_300_000, 4_300_400), (len(long) - 1000, len(long))]
    assert [got[i]["n_removed"] for i in range(5)] == [2000, 600, 0, 1000, 400]


def test_names_tell_grams_apart():
    data = np.frombuffer(b"abcabcabdabc" * 40, np.uint8)
    names = suffixes.Names(data, suffixes._FIRST)
    for length in (3, 25, 26, 60, 100, 213):
        at = np.arange(len(data) - length + 1)
        told = defaultdict(set)
        for i, name in zip(at, names.of(at, length)):
            told[name].add(data[i : i + length].tobytes())
        assert all(len(v) == 1 for v in told.values()) and len(told) == len({data[i : i + length].tobytes() for i in at})
