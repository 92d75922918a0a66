"""Very long texts, names that clash and repeated ids, for every operator."""

import hashlib
import random
import zlib

import pytest
from brute import words
from pyspark.sql import functions as F

from emberflow.llm import fingerprints, jaccard, language, mixing, packing, pii, sharding, tokens, toxicity
from emberflow.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def long_docs(spark):
    """Two near copies of 150,000 words, one of them twice under one id with another text, empty and null ones; columns
    whose names the operators use themselves."""
    rng = random.Random(12)
    w = [f"w{rng.randrange(5000)}" for _ in range(150_000)]
    near = list(w)
    for _ in range(1500):
        near[rng.randrange(len(near))] = "edited"
    rows = [(1, " ".join(w), "s"), (2, " ".join(near), "s"), (2, "short text of its own, call +1 (555) 123-4567 now", "t"), (3, None, None), (4, "", "t"), (5, "short text of its own, call +1 (555) 123-4567 now", "t")]
    names = ["block", "node", "digest", "shard", "size", "group", "pack_group", "_md5", "toxicity", "_toxicity", "_mix_id", "_key", "part", "_range", "kind", "key"]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in names]).repartition(3)


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def test_words_and_similarity(long_docs):
    source = texts(long_docs)
    got = language.score(long_docs).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == sorted((i, len(words(t)) + 1) for i, t in source)
    comp = {(r["doc_id"], r["component_id"]) for r in jaccard.join_components(long_docs).collect()}
    assert comp == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 1)}
    kept = jaccard.keep_one(long_docs)
    assert kept.columns == long_docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]
    assert {(r["doc_id"], r["class_id"]) for r in fingerprints.near_duplicates(long_docs).collect()} == {(2, 1), (5, 1)}
    prints = fingerprints.fingerprint_edits(long_docs).collect()
    assert sorted((r["doc_id"], r["n_chars"]) for r in prints) == sorted((i, len(t)) for i, t in source)


def test_tokens_packing_and_placing(long_docs):
    source = texts(long_docs)
    path, words_path = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
    tok, word_tok = tokens.encoder(path).tok, tokens.encoder(words_path).tok
    got = tokens.count_tokens(long_docs, path).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == sorted((i, len(t.encode()), len(tok.encode(t).ids)) for i, t in source)
    packed = packing.pack(long_docs, words_path).collect()
    assert sum(r["length"] for r in packed) == sum(len(word_tok.encode(t, add_special_tokens=False).ids) + 1 for _, t in source)
    mixed = mixing.mix(long_docs).collect()
    assert sorted((r["doc_id"], r["size"]) for r in mixed) == sorted((i, len(words(t))) for i, t in source)
    assert mixing.mixed_documents(long_docs).columns == long_docs.columns
    placed = sharding.assign_shards(long_docs, sharding.Tree.even(2, 3, 4), 6).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in placed) == sorted((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in source)


def test_models(spark, long_docs):
    source = texts(long_docs)
    finder = pii.fit(long_docs)
    for r in pii.find(long_docs, finder).collect():
        assert r["base_sha256"] in {hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in pii.base_spans(t)).encode()).hexdigest() for i, t in source if i == r["doc_id"]}
    clean = pii.redact(long_docs, finder)
    assert clean.columns == long_docs.columns and clean.filter("text like '%[PHONE]%'").count() == 2
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    m = toxicity.fit(long_docs, labels)
    out = toxicity.score(long_docs, m)
    assert out.columns == [*long_docs.columns, "toxicity_"] and out.filter("toxicity_ between 0 and 1").count() == 6
    assert toxicity.keep_clean(long_docs, m).columns == long_docs.columns
