import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberflow.llm import boosting, language, ngrams, pii, toxicity
from emberflow.llm.boosting import boost


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 10**12), max_size=300), st.lists(st.integers(0, 10**12), max_size=50))
def test_elias_fano(values, asked):
    v = np.unique(np.array(values, np.uint64))
    ef = ngrams.EliasFano.build(v)
    assert (ef.values() == v).all()
    q = np.unique(np.array(asked + values[:20], np.uint64))
    place = {x: i for i, x in enumerate(v.tolist())}
    assert ef.successors(q).tolist() == [place.get(x, -1) for x in q.tolist()]


def test_long_sequences():
    v = np.cumsum(np.random.default_rng(0).integers(0, 1000, 20000)).astype(np.uint64)
    ef = ngrams.EliasFano.build(v)
    assert (ef.values() == v).all() and sum(a.nbytes for a in ef.arrays) < 2.5 * len(v)


def test_trie_lookup():
    rng = np.random.default_rng(2)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (800, 2))})
    ctx = sorted({a for a, _ in pairs})
    pointers = np.concatenate([[0], np.cumsum([sum(a == c for a, _ in pairs) for c in ctx])])
    logs = -rng.random(len(pairs)) * 5
    trie = ngrams.Trie(np.array(ctx, np.uint64), pointers, np.array([b for _, b in pairs], np.uint64), logs)
    every = [(a, b) for a in range(70) for b in range(70)]
    codes = trie.lookup(np.array([a for a, _ in every], np.uint64), np.array([b for _, b in every], np.uint64))
    known = {p: i for i, p in enumerate(pairs)}
    for p, c in zip(every, codes):
        assert (c > 0) == (p in known)
        if c:
            assert trie.book[c] <= 10 ** logs[known[p]] * 1.0001


def model(rows, held):
    c, pairs, ctx = Counter(), Counter(), Counter()
    for i, w in rows:
        if not held[i]:
            c.update(w), pairs.update(zip(["<s>", *w[:-1]], w)), ctx.update(["<s>", *w[:-1]])
    return c, pairs, ctx


@pytest.mark.parametrize("block, split, asked", [(2_000_000, 1_000_000, 2_000_000), (800, 20, 500)])
def test_language_scores(spark, docs, nothing, monkeypatch, block, split, asked):
    monkeypatch.setattr(language, "BLOCK", block)
    monkeypatch.setattr(language, "SPLIT", split)
    monkeypatch.setattr(language, "ASKED", asked)
    got = language.score(docs).collect()
    source = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = [(i, [*words(t), None]) for i, t in source]
    held = {i: zlib.crc32(("null" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    c, pairs, ctx = model(rows, held)
    n, v = sum(c.values()), len(c)
    base = Counter((i, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6), len(t), sum(c[w] > 0 for w in t)) for i, t in rows)
    assert Counter((r["doc_id"], round(r["base_score"], 6), r["n_tokens"], r["n_known"]) for r in got) == base
    assert {r["train_tokens"] for r in got} == {n} and all(r["held_out"] == held[r["doc_id"]] for r in got)
    words_seen = [x for w, x in c.items()]
    d1 = words_seen.count(1) / (words_seen.count(1) + 2 * words_seen.count(2))
    follow = Counter(a for a, _ in pairs)
    d = min(0.95, max(0.1, sum(x == 1 for x in pairs.values()) / (sum(x == 1 for x in pairs.values()) + 2 * sum(x == 2 for x in pairs.values()))))
    logs = [math.log10((x - d) / ctx[a]) for (a, _), x in pairs.items()]
    step = (max(logs) - min(logs)) / 126  # half of a codebook's cuts lie evenly over the logarithms
    for r in got:
        want = 0.0
        for a, b in zip(["<s>", *words(dict(source)[r["doc_id"]])], [*words(dict(source)[r["doc_id"]]), None]):
            one = (c[b] - d1) / n if c[b] else d1 * v / n
            want += math.log10((max(pairs[a, b] - d, 0) + d * follow[a] * one) / ctx[a] if ctx[a] else one)
        assert want - r["n_tokens"] * step - 1e-3 <= r["score"] <= want + 1e-3
        assert r["score"] <= 1e-9
    assert language.score(nothing).count() == 0


def test_scores_without_training_rows(spark):
    one = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = language.score(spark.createDataFrame([(one, "a b")], "doc_id long, text string")).first()
    assert (r["train_tokens"], r["n_tokens"], r["n_known"], r["score"], r["base_score"]) == (0, 3, 0, 0.0, 0.0)


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1.2@-+ ()5é%", max_size=40) | st.from_regex(r"(\+?[0-9 ().-]{5,20}|[a-z.]+@[a-z.]{2,9}|4[0-9 ]{14,22}|[0-9.]{7,20}){1,4}"))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_pii(docs, nothing):
    finder = pii.fit(docs)
    rows = docs.collect()
    texts = {r["doc_id"]: r["text"] or "" for r in rows}
    for r in pii.find(docs, finder).collect():
        base = plain_spans(texts[r["doc_id"]])
        told = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert set(filter(None, told.split(","))) <= set(r["spans"].split(","))
        assert r["n_email"] == sum(k == "email" for k, _, _ in base)
    clean = pii.redact(docs, finder)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    for r in clean.collect():
        assert not plain_spans(r["text"] or "") and (r["text"] is None or r["n_chars"] == len(r["text"]))
        if not plain_spans(texts[r["doc_id"]]) and r["doc_id"] is not None and r["doc_id"] < 8:
            assert (r["text"] or "") == texts[r["doc_id"]]
    assert pii.find(nothing, finder).count() == 0
    assert pii.find(docs, pii.fit(nothing)).count() == len(rows)


def planted(n, rewrite, seed, bases=True):
    """(text, spans rewritten in it) with base spans, decoys and, for `rewrite`, spans in other forms."""
    rng = random.Random(seed)
    some = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    prose = lambda k: " ".join(word() for _ in range(k))

    def one(kind, good=True):
        if kind == "email":
            return f"{word()}.{some(2)}@mail{some(1)}.example.com"
        if kind == "ip":
            return ".".join(str(rng.randint(1, 255) if good else rng.randint(300, 900)) for _ in range(4))
        if kind == "card":
            head = "4" + some(14)
            return head + next(c for c in "0123456789" if pii.luhn(head + c) == good)
        return f"+1 ({some(3)}) 555-{some(4)}"

    rows = []
    for i in range(n):
        text, spans = prose(8), []
        kind = pii.KINDS[i % 4]
        if bases:
            text += f" {one(kind)} {prose(4)}"
        text += f" of 2019-01-{i % 28 + 1:02d} page {rng.randrange(99)} at {word()} no {one('card', False)} or {some(40)} and 1.{rng.randrange(99)} {prose(3)} "
        if i in rewrite:
            s = pii.rewritten(one(kind), kind, rng)
            spans.append((kind, len(text), len(text) + len(s)))
            text += s + " " + prose(5)
        rows.append((text, spans))
    return rows


@pytest.mark.parametrize("n, max_docs", [(1200, 6000), (1200, 400), (12, 6000)])
def test_rewritten_spans_are_added_and_decoys_are_not(spark, n, max_docs):
    """Learnt from a corpus of base spans and decoys; precision and recall on texts with planted rewritten spans."""
    learn = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(planted(n, set(), 1))], "doc_id long, text string")
    finder = pii.fit(learn, max_docs=max_docs)
    assert pii.find(learn, finder).agg(F.sum("n_added")).first()[0] <= 0.02 * n
    rows = planted(400, set(range(0, 400, 2)) | set(range(1, 400, 4)), 2)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    right = wrong = missed = 0
    for r in pii.find(docs, finder).collect():
        text, spans = rows[r["doc_id"]]
        base = {f"{k}:{s}:{e}" for k, s, e in plain_spans(text)}
        want = {f"{k}:{s}:{e}" for k, s, e in spans} - base
        added = set(r["spans"].split(",")) - base
        right, wrong, missed = right + len(added & want), wrong + len(added - want), missed + len(want - added)
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.8


def test_added_spans_are_those_of_a_plain_search(spark):
    finder = pii.fit(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(planted(400, set(), 3))], "doc_id long, text string"))

    def chance(model, x):
        z = model.base
        for nodes in model.trees:
            k = 0
            while nodes[k][0] >= 0:
                f, cut, left, right, _ = nodes[k]
                k = left if sum(c <= np.float32(x[f]) for c in model.cuts[f]) <= cut else right
            z += model.rate * nodes[k][4]
        return 1 / (1 + math.exp(-min(30, max(-30, z))))

    for text, _ in planted(60, set(range(60)), 4):
        base = plain_spans(text)
        free = [c for c in pii.candidates(text) if all(c[2] <= s or e <= c[1] for _, s, e in base)]
        scored = sorted((-chance(finder.trees[c[0]], pii.format_features(text, *c)), c[1], -c[2], c) for c in free)
        want = []
        for p, _, _, c in scored:
            if -p >= finder.thresholds[c[0]] and all(c[2] <= s or e <= c[1] for _, s, e in want):
                want.append(c)
        assert sorted(finder.added(text, base)) == sorted(want)


def test_thresholds():
    """By estimate from rewritten, spoilt and the corpus's own candidates, of which nobody knows which are true."""
    rng = np.random.default_rng(2)
    true, none = rng.uniform(0.7, 0.99, 400), np.zeros(0)
    decoys = rng.uniform(0, 0.3, 5000)
    own = lambda k: np.concatenate([decoys, rng.uniform(0.7, 0.99, k)])
    for k in (0, 50, 2500):
        natural = own(k)
        assert pii.threshold_of(natural, np.ones(len(natural)), true, none, 0.98) == 0.5
        assert abs(pii.share_of(natural, np.ones(len(natural)), true) - k / len(natural)) < 0.02
    # Decoys that score like a half of the rewritten ones push the threshold over them.
    natural = np.concatenate([decoys, rng.uniform(0.5, 0.8, 3000), rng.uniform(0.7, 0.99, 100)])
    assert pii.threshold_of(natural, np.ones(len(natural)), np.concatenate([true, rng.uniform(0.9, 0.99, 4000)]), none, 0.98) > 0.79
    # Spoilt ones that score like rewritten ones do so too, and where nothing tells them apart nothing is added.
    assert pii.threshold_of(none, none, true, np.linspace(0.7, 0.8, 300), 0.98) > 0.79
    assert pii.threshold_of(none, none, np.array([0.6]), np.array([0.99]), 0.9) == 2.0
    assert pii.threshold_of(none, none, none, none, 0.9) == 2.0


@pytest.mark.parametrize(("n", "share"), [(3000, 0.01), (1200, 0.1), (1200, 0.5)])
def test_rewritten_spans_are_found_in_the_corpus_that_is_learnt_from(spark, n, share):
    """Nobody says which of the corpus's own candidates are true: few, some or half of its documents hold one."""
    rows = planted(n, set(random.Random(7).sample(range(n), int(n * share))), 5)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    right = wrong = missed = 0
    for r in pii.find(docs, pii.fit(docs)).collect():
        text, spans = rows[r["doc_id"]]
        base = {f"{k}:{s}:{e}" for k, s, e in plain_spans(text)}
        want, added = {f"{k}:{s}:{e}" for k, s, e in spans} - base, {x for x in r["spans"].split(",") if x} - base
        right, wrong, missed = right + len(added & want), wrong + len(added - want), missed + len(want - added)
    assert right / max(1, right + wrong) >= 0.9 and right / (right + missed) >= 0.8


def test_all_documents_are_learnt_from(spark, monkeypatch):
    """No bound on documents changes a finder, every candidate is counted, and cells in parts give the same trees."""
    texts = [t for t, _ in planted(300, set(range(0, 300, 5)), 6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    finder = pii.fit(docs)
    bounded = pii.fit(docs, max_docs=40)
    assert bounded.thresholds == finder.thresholds
    assert all(bounded.trees[k].trees == model.trees for k, model in finder.trees.items())
    free = Counter(c[0] for t in texts for c in pii.candidates(t) if all(c[2] <= s or e <= c[1] for _, s, e in pii.base_spans(t)))
    told = pii.lessons_of(docs).filter("mark = 0").groupBy("kind").agg(F.sum(F.expr("n0 + n1 + n2 + n3")).alias("n"))
    assert {pii.KINDS[r["kind"]]: r["n"] for r in told.collect()} == free
    monkeypatch.setattr(boosting, "ROUNDS", 12)
    for k, model in pii.fit(docs, each=150).trees.items():
        assert model.trees == finder.trees[k].trees[:12]


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    p = boost(x[:1500], y[:1500]).chance(x[1500:])
    assert ((p > 0.5) == (y[1500:] == 1)).mean() > 0.95


def toxic_rows(n=900):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(10, 60))]
        bad = rng.random() < 0.15
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["grumble", "snarl", "spitefulness"]) + rng.choice(["", ".", ","]))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity(spark, nothing):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, None, "y"), (5000, "", "z")], "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2] + [(None, 1), (3, None), (1, 0)], "doc_id long, toxic int")
    own = lambda df: df.filter(F.col("doc_id") % 3 != 1)
    m = toxicity.fit(own(docs), own(labels))
    got = {r["doc_id"]: r["p"] for r in toxicity.score(docs, m, "p").collect()}
    held = [(got[i], y) for i, _, y in rows if i % 3 == 1]
    assert np.mean([(p >= 0.7) == (y == 1) for p, y in held]) > 0.95
    assert got[None] == got[5000] and 0 <= min(got.values()) and max(got.values()) <= 1
    kept = toxicity.keep_clean(docs, m)
    assert kept.columns == docs.columns and kept.filter("doc_id = 5000 or doc_id is null").count() == 2
    assert toxicity.score(docs, m).columns == [*docs.columns, "toxicity_"]
    assert toxicity.score(docs.limit(0), m, "p").count() == 0


def test_toxicity_learns_from_all_documents(spark):
    """Groups of documents find what all together do."""
    rows = toxic_rows(2400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2], "doc_id long, toxic int")
    models = [toxicity.fit(docs, labels, each=each) for each in (10_000, 500)]
    assert (models[0].ids == models[1].ids).all()
    a, b = (m.score(pa.array([t for _, t, _ in rows])) for m in models)
    truth = np.array([y for _, _, y in rows]) == 1
    for p in (a, b):
        assert ((p >= 0.7) == truth).mean() > 0.95
    assert ((a >= 0.7) == (b >= 0.7)).mean() > 0.98


def test_toxicity_features_are_counted_over_all_documents(spark):
    """A word of 40 in 8,000 positives tells them apart; of half of these it wouldn't."""
    text = F.when(F.col("id") % 400 == 7, "zyxwvut plain").otherwise("plain words").alias("text")
    docs = spark.range(16_000).select(F.col("id").alias("doc_id"), text)
    m = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    assert set(toxicity.features(pa.array(["zyxwvut"]))[1].tolist()) <= set(m.ids.tolist())


def test_nnpu_risk_and_gradient():
    """Against a risk written out row by row, and its differences."""
    rng = np.random.default_rng(8)
    pos, unl = ((rng.random((n, 6)) < 0.4).astype(float) for n in (7, 20))
    for scale, prior in ((0.3, 0.2), (3.0, 0.45)):
        w = rng.normal(size=7) * scale
        plain = lambda w: (prior * sum(math.log1p(math.exp(-(r @ w[:-1] + w[-1]))) for r in pos) / 7, sum(math.log1p(math.exp(r @ w[:-1] + w[-1])) for r in unl) / 20 - prior * sum(math.log1p(math.exp(r @ w[:-1] + w[-1])) for r in pos) / 7)
        assert toxicity.risk(w, pos, unl, prior) == pytest.approx(plain(w))
        part = (lambda w: sum(plain(w))) if plain(w)[1] >= 0 else (lambda w: -plain(w)[1])
        steps = [(part(w + 1e-6 * e) - part(w - 1e-6 * e)) / 2e-6 for e in np.eye(7)]
        assert toxicity.gradient(w, pos, unl, prior) == pytest.approx(steps, abs=1e-6)


def test_nnpu_finds_the_least_risk():
    rng = np.random.default_rng(9)
    x = (rng.random((900, 12)) < 0.3).astype(np.float32)
    y = (x[:, 0] + x[:, 1] > 0) & (rng.random(900) < 0.9)
    w, b = toxicity.train_nnpu(x[y][:100], x, float(y.mean()), decay=1e-4)
    first, second = toxicity.risk(np.append(w, b), x[y][:100].astype(float), x.astype(float), float(y.mean()))
    for _ in range(200):
        a, c = toxicity.risk(np.append(w, b) + rng.normal(size=13) * 0.3, x[y][:100].astype(float), x.astype(float), float(y.mean()))
        assert first + max(0.0, second) <= a + max(0.0, c) + 0.02


def test_scores_are_those_of_single_texts(texts):
    rng = np.random.default_rng(1)
    _, f = toxicity.features(pa.array(texts[:40]))
    ids = np.unique(f)[::3]
    m = toxicity.Model(ids, rng.normal(size=len(ids)), -0.5)
    for t, s in zip(texts, m.score(pa.array(texts))):
        held = set(toxicity.features(pa.array([t]))[1].tolist())
        z = -0.5 + sum(w for i, w in zip(ids.tolist(), m.weights.tolist()) if i in held)
        assert s == pytest.approx(1 / (1 + math.exp(-z)))


def test_toxicity_without_positives(spark, docs):
    m = toxicity.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert len(set(m.score(pa.array(["a", "b", ""])).tolist())) == 1
