import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import WORD, shingles, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberflow.llm import arrays, packing, tokens
from emberflow.llm.queries import tokenizer_path

NASTY = st.lists(st.text(alphabet="aB1é'.,<|>\n\t \x1c\x85  一ñ", max_size=30) | st.sampled_from(["<|endoftext|>", " <|endoftext|> x", "don't  stop", "a\n\nb", " lead", "trail ", "ÀÉ ñ 12345"]), max_size=6)


@settings(max_examples=60, deadline=None)
@given(NASTY)
def test_words_and_shingles(texts):
    col = pa.array(texts, pa.string())
    h, ptr = arrays.words(col)
    assert [b - a for a, b in zip(ptr[:-1], ptr[1:])] == [len(words(t)) for t in texts] == list(arrays.count_words(col))
    assert len(set(h.tolist())) == len({w for t in texts for w in words(t)})
    assert [len(s) for s in arrays.shingle_sets(col)] == [len(shingles(t)) for t in texts]


@settings(max_examples=60, deadline=None)
@given(NASTY)
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_library(name, texts):
    enc = tokens.encoder(tokenizer_path(name))
    want = [np.array(enc.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert enc.encode(texts) == want


def test_counts_and_cache(spark, docs, nothing, tmp_path):
    path, cache = tokenizer_path("byte_bpe_50k.json"), str(tmp_path / "cache")
    got = tokens.count_tokens(docs, path, cache).collect()
    tok = tokens.encoder(path).tok
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, len((r["text"] or "").encode()), len(tok.encode(r["text"] or "").ids)) for r in docs.collect())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got) == want
    kept = spark.read.parquet(cache)
    n = kept.count()
    assert n == docs.select(F.coalesce("text", F.lit(""))).distinct().count() == kept.select("digest").distinct().count()
    assert tokens.count_tokens(docs, path, cache).count() == len(want)
    assert spark.read.parquet(cache).count() == n, "known texts are encoded again"
    assert tokens.count_tokens(nothing, path).count() == 0


def test_packing_keeps_every_id_once(docs, nothing):
    path = tokenizer_path("word_bpe_49k.json")
    got = packing.pack(docs, path, capacity=256).collect()
    tok = tokens.encoder(path).tok
    by_seq, by_doc = {}, {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    for r in docs.dropDuplicates(["doc_id"]).collect():
        ids = np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        own = by_doc[r["doc_id"]]
        copies = 3 if r["doc_id"] == 9 else 1
        assert sum(p["length"] for p in own) == copies * len(ids)
        for p in own:
            assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
    assert packing.pack(nothing, path).count() == 0


def test_groups_do_not_follow_file_splits(docs, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 15)
    path, once = tokenizer_path("word_bpe_49k.json"), []
    for df in (docs.repartition(1), docs.repartition(6)):
        once.append(sorted(map(str, packing.pack(df, path, capacity=256).collect())))
    assert once[0] == once[1]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_decreasing(sizes):
    sizes = sorted(sizes, reverse=True)
    bins, _ = packing.first_fit_decreasing(np.array(sizes, np.int64), 50)
    room, want = [], []
    for x in sizes:
        k = next((i for i, r in enumerate(room) if r >= x), len(room))
        if k == len(room):
            room.append(50)
        room[k] -= x
        want.append(k)
    assert bins.tolist() == want


def test_word_pattern():
    assert WORD.findall(b"a\x0bb\x1cc d") == [b"a", b"b\x1cc", b"d"]


def test_words_are_parted_where_tokens_end_anyhow():
    enc = tokens.Encoder(tokenizer_path("word_bpe_49k.json"))
    assert enc.parts and tokens._parted(b"ab.c 12-x's 'tis$$ d''e") == b"ab . c 12 - x's 'tis $$ d''e"
    rng = random.Random(4)
    signs = ["a", "B", "é", "'", "'s", "'re", "1", "٣", "$", "_", ".", "-", " ", "\n", "<|", "|>", "<|endoftext|>", "≠", "\u0301", "日", "ß", "İ", "ſ", "ª", "!", "«", "a'", "9'"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(5000)]
    assert enc.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in enc.tok.encode_batch_fast(texts, add_special_tokens=False)]
