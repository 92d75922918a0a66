"""Tokens of whole texts by public tokenizers: ids, and counts kept in a digest cache.

A text is cut only where the tokenizer would cut it anyway; the library encodes each distinct chunk once and the
chunks' results are joined. Texts in which such cuts aren't certain are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberflow.llm.common import key_text, ready, shared_dir, small, stored, text_of

#: Chunks that a worker remembers, and the longest of them in bytes.
MEMO, LONGEST = 600_000, 48
#: Digests that hold more than one in so many rows are few enough to broadcast.
HOT = 1000
#: White space other than 0x09-0x0D and the space, and characters that libraries class differently.
_ODD = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
_RUN = re.compile(rb"[\x09-\x0d ]{2}|^[\x09-\x0d ]|[\x09-\x0d ]$")


#: 1 for ASCII letters, 2 for digits, 3 for signs that end what stands before them, 0 for all else: white space, the
#: apostrophe, which may begin a token of letters, and bytes above 0x7F.
_SIGN = np.zeros(256, np.uint8)
_SIGN[0x21:0x7F] = 3
_SIGN[ord("'")] = 0
_SIGN[ord("0") : ord("9") + 1] = 2
_SIGN[ord("A") : ord("Z") + 1] = _SIGN[ord("a") : ord("z") + 1] = 1
_APART = np.zeros((4, 4), bool)
_APART[1:, 1:] = ~np.eye(3, dtype=bool)


def _parted(data: bytes) -> bytes:
    """data with a space wherever a letter, a digit and a sign stand side by side in ASCII: tokens end there anyhow."""
    x = np.frombuffer(data, np.uint8)
    kind = _SIGN[x]
    at = np.flatnonzero(_APART[kind[:-1], kind[1:]]) + 1
    if not len(at):
        return data
    # Bytes move on by the number of spaces put in before them.
    step = np.ones(len(x), np.int64)
    step[at] += 1
    out = np.full(len(x) + len(at), 32, np.uint8)
    out[np.cumsum(step) - 1] = x
    return out.tobytes()


class Encoder:
    """ids (little-endian unsigned 32-bit, as bytes) of texts by one tokenizer file of the `tokenizers` library."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(open(path, encoding="utf-8").read())
        kinds = str((spec.get("normalizer"), spec.get("pre_tokenizer")))
        #: Drops white space: chunks are words. Keeps it: a chunk is a word with the one space before it.
        self.drops = "'Removed'" in kinds and "'invert': True" in kinds and "\\\\s+" in kinds
        self.lowers = self.drops and "Lowercase" in kinds
        #: Letters, single digits and runs of other signs are tokens apart, so a word needn't be met with each comma after it.
        self.parts = self.lowers and "|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in kinds
        self.keeps = (spec.get("normalizer") is None) and "'type': 'ByteLevel'" in kinds and "'use_regex': True" in kinds and "'add_prefix_space': False" in kinds
        self.memo: dict[bytes, bytes] = {}

    def _fresh(self, chunks: list[bytes]) -> list[bytes]:
        got = self.tok.encode_batch_fast([c.decode("utf-8") for c in chunks], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in got]

    def _chunks(self, text: str) -> list[bytes]:
        data = text.encode("utf-8")
        if self.drops:
            if not self.lowers or b"<|" in data:
                return data.split()
            return (_parted(data.lower()) if self.parts else data.lower()).split()
        if not self.keeps or _ODD.search(text) or _RUN.search(data):
            return [data]
        first, *rest = data.split(b" ")
        return [first, *[b" " + x for x in rest]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each text."""
        cut = [self._chunks(t) for t in texts]
        memo, more = self.memo, {}
        new = list(set().union(*cut).difference(memo)) if cut else []
        for i in range(0, len(new), 4096):
            for c, ids in zip(new[i : i + 4096], self._fresh(new[i : i + 4096])):
                (memo if len(c) <= LONGEST and len(memo) < MEMO else more)[c] = ids
        if not more:
            return [b"".join(map(memo.__getitem__, x)) for x in cut]
        return [b"".join([memo[c] if c in memo else more[c] for c in x]) for x in cut]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a worker and file, so chunks are remembered over tasks."""
    return Encoder(path)


def version(path: str) -> str:
    """Digest of the tokenizer's file and library, which a count depends on."""
    import tokenizers

    return hashlib.sha256(open(path, "rb").read() + tokenizers.__version__.encode()).hexdigest()


def count_tokens(docs: DataFrame, path: str, cache: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every text, through a digest cache.

    cache is a folder that all executors share, a Parquet table (digest, version, n_tokens) made when missing; None
    takes a new one. Texts are hashed once (sha256; this tokenizer changes nothing before it reads; a null text is the
    empty one), and digests with the tokenizer's version are looked up in the cache. One text of each digest that isn't
    there is encoded, whole, and appended; with a cache that knows all, no text is read again. Digests of a large share
    of rows, of which there can't be many, take their counts by a broadcast, so copies don't meet in one task. Equal
    texts cost one encoding. Repeated doc_ids keep their rows; an empty table gives no rows.
    """
    spark = ready(docs.sparkSession)
    cache = cache or shared_dir(spark) + "/token-counts"
    own = version(path)
    schema = "digest binary, version string, n_tokens long"
    texts = docs.select("doc_id", text_of().alias("text"))
    rows = stored(texts.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")))
    there = spark._jvm.org.apache.hadoop.fs.Path(cache)
    known = spark.read.schema(schema).parquet(cache) if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there) else spark.createDataFrame([], schema)
    known = known.filter(F.col("version") == own).select("digest")
    one = stored(rows.groupBy("digest").agg(F.min(key_text()).alias("_one"), F.count("*").alias("_n")))
    misses = one.join(known, "digest", "left_anti")

    def encode(batches):
        enc = encoder(path)
        for b in small(batches):
            new = dict(zip(b["digest"].to_pylist(), b["text"].to_pylist()))  # rows repeated with their id come once
            n = [len(x) // 4 for x in enc.encode(list(new.values()))]
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array([own] * len(n), pa.string()), pa.array(n, pa.int64())], ["digest", "version", "n_tokens"])

    if not misses.isEmpty():
        wanted = misses.select("_one", F.col("digest").alias("_d"))
        todo = texts.withColumn("_key", key_text()).join(wanted.hint("shuffle_hash"), F.col("_key") == F.col("_one")).select("text", "_d")
        todo = todo.filter(F.unhex(F.sha2("text", 256)) == F.col("_d")).select(F.col("_d").alias("digest"), "text")
        todo.mapInArrow(encode, schema).dropDuplicates(["digest"]).write.mode("append").parquet(cache)
    counts = spark.read.schema(schema).parquet(cache) if one.count() else spark.createDataFrame([], schema)
    counts = counts.filter(F.col("version") == own).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # At most HOT digests hold more than a HOT-th of the rows.
    hot = stored(one.filter(F.col("_n") > rows.count() / HOT).select("digest").join(counts, "digest"))
    rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(counts, "digest")
    return rest.unionByName(rows.join(F.broadcast(hot), "digest")).select("doc_id", "n_bytes", "n_tokens")
