import hashlib
import random

import numpy as np
import pytest
from brute import components as brute_components
from brute import shingles
from hypothesis import given, settings
from hypothesis import strategies as st

from emberflow.llm import fingerprints, jaccard, nearest
from emberflow.llm.graph import components, forest


def by_id(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def brute_of_rows(rows):
    """Components of doc_ids for rows (doc_id, text) in which ids may repeat: texts of one id are linked."""
    sets = [(i, shingles(t)) for i, t in rows]
    links = [(a, b) for a, s in sets for b, t in sets if a is not None and b is not None and s and t and 100 * len(s & t) >= 80 * len(s | t)]
    return {i: r for i, r in _closed([i for i, _ in rows if i is not None], links).items()}


def _closed(ids, links):
    root = {i: i for i in ids}
    for _ in range(len(root) + 1):
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root


@pytest.mark.parametrize("chunk, block", [(2000, 1_500_000), (4, 1500)])
def test_jaccard_join_is_exact(spark, docs, nothing, monkeypatch, chunk, block):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    monkeypatch.setattr(jaccard, "CHUNK_TOKENS", 10**9)
    monkeypatch.setattr(jaccard._blocks, "__defaults__", ("doc_id", block))
    monkeypatch.setattr(jaccard, "SHARD", 200 if chunk == 4 else 1_000_000)
    got = jaccard.join_components(docs.repartition(3, "doc_id")).collect()
    assert len(got) == docs.count()
    texts = by_id(docs)
    want = brute_components({i: t for i, t in texts.items() if i is not None})
    for r in got:
        assert r["n_shingles"] == len(shingles(texts[r["doc_id"]]))
        assert r["component_id"] == want.get(r["doc_id"])
    assert any(want[i] != i for i in want)
    assert jaccard.join_components(nothing).count() == 0


def test_rows_that_share_an_id_with_different_texts(spark):
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(0, 60, 6):
        a, b, c = words(80), words(90), words(70)
        near = lambda w: " ".join([*w[:-2], "x", "y"])
        rows += [(k + 1, " ".join(a)), (k + 1, " ".join(b)), (k + 2, near(b)), (k + 3, near(a)), (k + 5, " ".join(c)), (k + 4, near(c)), (k + 5, near(c)), (k + 4, None)]
    rows += [(None, rows[0][1]), (7, rows[0][1]), (7, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_of_rows(rows)
    got = jaccard.join_components(df).collect()
    assert len(got) == len(rows)
    assert all(r["component_id"] == want.get(r["doc_id"]) for r in got)
    kept = jaccard.keep_one(df).collect()
    first = {i: min(t or "" for j, t in rows if j == i) for i in set(want.values())}
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept) == sorted([*first.items(), (-1, rows[0][1])])


def test_links_between_a_large_cluster_and_others(spark, monkeypatch):
    """Clusters of several chunks that are tied to others by tokens, some linked through one member only."""
    monkeypatch.setattr(jaccard, "CHUNK", 20)
    rng = random.Random(11)
    rows = []
    for k in range(3):
        base = [f"w{k}.{i}" for i in range(300)]
        for j in range(50):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(300)] = f"n{rng.random()}"
            rows.append((1000 * k + j, " ".join(w)))
        for j in range(12):
            at = rng.randrange(30)
            rows.append((1000 * k + 500 + j, " ".join([*base[at : at + 255 - 2 * j], *[f"o{k}.{j}.{i}" for i in range(30 + j)]])))
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_components(dict(rows))


def test_keep_one(docs):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    want = brute_components({i: t for i, t in by_id(docs).items() if i is not None})
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(want.values()))


def test_many_near_copies_of_one_text(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(200)] = f"n{rng.random()}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(dict(rows))


@pytest.mark.parametrize("others", [0, 3])
def test_near_copies_of_very_long_texts(spark, others):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    near = list(words)
    for _ in range(2000):
        near[rng.randrange(len(near))] = f"n{rng.randrange(10**6)}"
    rows = [(7, " ".join(words)), (3, " ".join(near)), *[(20 + i, " ".join(f"o{rng.randrange(10**6)}" for _ in range(200_000))) for i in range(others)]]
    want = brute_components(dict(rows))
    assert want[7] == 3
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert got == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), min_size=1, max_size=30))
def test_forest(links):
    u, v = np.array(links, np.int64).T
    got = dict(zip(*map(np.ndarray.tolist, forest(u, v))))
    root = {i: i for p in links for i in p}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {i: r for i, r in root.items() if r != i}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "u long, v long")
    got = {r["v"]: r["root"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_fingerprints(docs, nothing):
    rows = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    texts = {i: t or "" for i, t in by_id(docs).items() if i is not None}
    ids = sorted(texts, reverse=True)
    assert sorted(rows) == sorted(texts)
    off = []
    for k, i in enumerate(ids):
        n, nxt = len(texts[i]), texts[ids[(k + 1) % len(ids)]]
        edited = texts[i][: n - n // 3] + nxt[: n // 3]
        assert rows[i]["n_chars"] == n and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(texts[i]), shingles(edited)
        if a | b:
            off.append(abs(len(a & b) / len(a | b) - rows[i]["near_edited"]))
    assert np.mean(off) < 0.05 and max(off) < 0.25
    prints = {}
    for i in ids:
        assert prints.setdefault(texts[i], rows[i]["fingerprint"]) == rows[i]["fingerprint"]
    assert fingerprints.fingerprint_edits(nothing).count() == 0
    assert fingerprints.fingerprint_edits(docs).count() == docs.count()


def test_fingerprints_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "parts", lambda n, each, least=1: 5)
    rows = [(i * 3, f"t{i} " + "a b c d e f g "[: i % 14]) for i in range(60)]
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (i, t) in enumerate(rows):
        nxt = rows[k - 1][1]
        assert got[i] == hashlib.sha256((t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]).encode()).hexdigest()


def test_near_duplicates_are_verified(docs):
    texts = by_id(docs)
    pairs = fingerprints.near_duplicates(docs).collect()
    assert pairs
    for r in pairs:
        a, b = shingles(texts[r["doc_id"]]), shingles(texts[r["leader"]])
        assert len(a & b) / len(a | b) == pytest.approx(r["jaccard"]) and r["jaccard"] >= 0.8


def test_near_duplicates_find_links_beside_the_leader(spark, docs):
    rows = []
    for k in range(5):
        base = [f"w{k}.{i}" for i in range(400)]
        # Sixty smaller ids share bands with the pair, but are like neither it nor each other by 0.8.
        rows += [(100 * k + j, " ".join([*base, *[f"p{k}.{j}.{i}" for i in range(120)]])) for j in range(60)]
        rows += [(100 * k + 90, " ".join(base)), (100 * k + 91, " ".join([*base[:370], *[f"c{k}.{i}" for i in range(30)]]))]
    for texts in (dict(rows), {i: t for i, t in by_id(docs).items() if i is not None}):
        found = fingerprints.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
        want = {i: r for i, r in brute_components(texts).items() if i != r}
        assert all(want[r["doc_id"]] == want.get(r["leader"], r["leader"]) for r in found)
        assert all(len(x & y) * 10 >= 8 * len(x | y) for r in found for x, y in [(shingles(texts[r["doc_id"]]), shingles(texts[r["leader"]]))])
        assert {r["doc_id"]: r["class_id"] for r in found} == want and len(found) == len(want)


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1050, [0.0] * 24), (1100, [float("nan")] * 24), (1150, [1.0, None] * 12), (1200, [1.0] * 7), (None, [1.0] * 24), (1250, [float("inf")] * 24)]
    got = nearest.nearest(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 900, 50):
        s = unit @ unit[q]
        s[q] = -9
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in own] == [1, 2, 3, 4, 5]
        assert all(abs(s[v] - c) < 1e-12 for _, v, c in own)
        hits += len({v for _, v, _ in own} & set(np.argsort(-s)[:5].tolist()))
    assert hits / 90 >= 0.9 and len(got) == 90
    few = nearest.nearest(spark.createDataFrame([(0, [1.0, 2.0]), (3, [2.0, 1.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 2), (2, 3)]
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_nearest_of_extreme_magnitudes_and_other_lengths(spark):
    rows = [(0, [1.0, 0.0, 0.5, 0.1]), (1, [1e-200, 0.0, 0.0, 1e-200]), (2, [1e200, 1e200, 0.0, 0.0]), (3, [5e-324, 0.0, 5e-324, 0.0]), (4, [1.7e308, 0.0, 1e308, 1e308])]
    rows += [(50, [1.0, 2.0]), (51, [2.0, 4.1]), (52, [-1.0, 1.0]), (100, [3.0])]
    got = {}
    for r in nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    from fractions import Fraction

    def cosine(a, b):
        a, b = ([Fraction(x) for x in v] for v in (a, b))
        dot, squares = sum(x * y for x, y in zip(a, b)), sum(x * x for x in a) * sum(x * x for x in b)
        return (1 if dot > 0 else -1) * float(dot * dot / squares) ** 0.5

    vectors = dict(rows)
    for q, same in ((0, (1, 2, 3, 4)), (50, (51, 52))):
        want = sorted((-cosine(vectors[q], vectors[v]), v) for v in same)
        assert [v for _, v, _ in sorted(got[q])] == [v for _, v in want]
        assert [s for *_, s in sorted(got[q])] == pytest.approx([-s for s, _ in want], abs=1e-14)
    assert 100 not in got


def test_nearest_of_many_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 64)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8)).round(1)
    x[rng.permutation(600)[:300]] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[7].tolist()), (50, x[9].tolist())]
    got = {}
    for r in nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7), every=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    unit = {}
    for i, v in rows:
        unit.setdefault(i, []).append(np.array(v) / np.linalg.norm(v))
    hits = 0
    for q in range(0, 600, 10):
        first = min((v for i, v in rows if i == q))
        a = np.array(first) / np.linalg.norm(first)
        want = sorted((-round(max(float(a @ v) for v in vs), 12), i) for i, vs in unit.items() if i != q)[:5]
        hits += len({i for _, i in want} & {i for _, i in got[q]})
        assert len(got[q]) == 5
    assert hits / 300 >= 0.9


def test_anisotropic_codes_favour_the_parallel_part():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    book = nearest.train(x)
    plain = nearest.Codebook(book.centres, 1.0, 1.0)

    def along(b):
        c = b.encode(x)
        near = np.stack([b.centres[m][c[:, m]] for m in range(len(b.centres))], 1).reshape(len(x), -1)[:, :32]
        return np.abs(((x - near) * x).sum(1)).mean()

    assert book.along > book.across and along(book) < along(plain)
