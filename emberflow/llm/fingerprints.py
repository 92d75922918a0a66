"""MinHash fingerprints of documents: 128 universal hashes over 5-word shingles, in vectorised numpy.

Permutation i maps a shingle x to the high half of a_i * x + b_i mod 2^64 (a_i odd); the least value over the set is
kept, cut to 16 bits. The share of equal places estimates the Jaccard similarity of two sets. `near_duplicates`
joins bands of the signature and compares the shingle sets of all that bands tie together.

Cases: a null text is the empty one; texts without words share one fingerprint that no other text has in effect
(all places 65535); with fewer than 5 words the whole sequence is the one shingle; rows with the same doc_id follow
each other in order of their text's hash; a null doc_id comes after all others; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberflow.llm import arrays, jaccard
from emberflow.llm.common import parts, ready, small, stored, text_of
from emberflow.llm.graph import components

N_HASHES = 128
#: Ranges of doc_id at most; each is a task.
PARTS = 1 << 15
_rng = np.random.default_rng(128)
_A = _rng.integers(0, 2**63, N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**64 - 1, N_HASHES, dtype=np.uint64)


def signatures(texts: pa.Array) -> np.ndarray:
    """One row of 128 unsigned 16-bit places for each text."""
    out = np.full((len(texts), N_HASHES), 0xFFFF, np.uint16)
    for at, part in arrays.pieces(texts, 1 << 19):
        s, ptr = arrays.shingles(*arrays.words(part))
        some = np.flatnonzero(np.diff(ptr))
        if not len(some):
            continue
        begins = ptr[:-1][some]
        for i in range(N_HASHES):
            out[at + some, i] = np.minimum.reduceat((s * _A[i] + _B[i]) >> np.uint64(32), begins).astype(np.uint16)
    return out


def told(sig: np.ndarray) -> str:
    """A signature as text."""
    return base64.b64encode(sig.astype("<u2").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal places, row by row."""
    return (a == b).mean(-1)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """For each document: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    document in descending doc_id; the last takes the first. Rows are cut by ranges of doc_id into parts; the row
    at a part's lower bound, which exists, is sent to the part above it too, and the largest to the lowest part, so
    each part finds its next documents itself and every text is moved once, compressed.
    """
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    n = min(PARTS, parts(docs.count(), 4000))
    # The largest doc_id of each of Spark's own ranges: at most PARTS numbers. A part is read as a stream, sorted by
    # Spark, so it may be of any size.
    ranges = rows.select("doc_id").filter("doc_id is not null").repartitionByRange(n, "doc_id").groupBy(F.spark_partition_id()).agg(F.max("doc_id").alias("m"))
    bounds = np.unique(np.array([r["m"] for r in ranges.collect()], np.int64))

    def deal(batches):
        press = zstandard.ZstdCompressor(level=1)
        for b in small(batches):
            known = ~b["doc_id"].is_null().to_numpy(zero_copy_only=False)
            ids = b["doc_id"].fill_null(0).to_numpy()
            part = np.where(known, np.searchsorted(bounds, ids), 0)
            also = [np.flatnonzero(known & (bounds[np.minimum(part, len(bounds) - 1)] == ids) & (part < len(bounds) - 1)), np.flatnonzero(known & (ids == bounds[-1]))] if len(bounds) else [np.zeros(0, int), np.arange(len(ids))]
            at = np.concatenate([np.arange(len(ids)), *also])
            texts = [press.compress(t.encode("utf-8")) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([part, part[also[0]] + 1, np.zeros(len(also[1]), int)]), pa.int64()), pa.array(np.repeat([0, 1], [len(ids), len(at) - len(ids)]), pa.int32()), b["doc_id"].take(pa.array(at)), b["tie"].take(pa.array(at)), pa.array([texts[i] for i in at], pa.binary())], ["part", "extra", "doc_id", "tie", "pressed"])

    dealt = rows.withColumn("tie", F.xxhash64("text")).mapInArrow(deal, "part long, extra int, doc_id long, tie long, pressed binary")
    order = dealt.repartition(n, "part").sortWithinPartitions("part", "extra", F.col("doc_id").desc_nulls_last(), "tie")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def chain(batches):
        unpress = zstandard.ZstdDecompressor()
        last = None  # (part, extra, doc_id, text, signature)
        for b in small(batches):
            texts = [unpress.decompress(x).decode("utf-8") for x in b["pressed"].to_pylist()]
            seen = list(zip(b["part"].to_pylist(), b["extra"].to_pylist(), b["doc_id"].to_pylist(), texts, signatures(pa.array(texts, pa.large_string()))))
            seen = ([last] if last else []) + seen
            last = seen[-1]
            # A row that was sent along ends its part; what follows it is another part.
            pairs = [(x, y) for x, y in zip(seen[:-1], seen[1:]) if not x[1] and x[0] == y[0]]
            edited = [x[3][: len(x[3]) - len(x[3]) // 3] + y[3][: len(x[3]) // 3] for x, y in pairs]
            sigs = signatures(pa.array(edited, pa.large_string()))
            own, following = (np.stack([p[k][4] for p in pairs]) if pairs else np.zeros((0, N_HASHES), np.uint16) for k in (0, 1))
            cols = [[x[2] for x, _ in pairs], [len(x[3]) for x, _ in pairs], [hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited], list(map(told, own)), list(map(told, sigs)), likeness(own, sigs), likeness(own, following)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return order.mapInArrow(chain, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 32) -> DataFrame:
    """doc_id, leader, jaccard, class_id: each document that isn't the smallest of its class, a document whose shingle
    set is verified to be that similar, their similarity, and the smallest doc_id that links reach.

    Documents of equal sets are one, the smallest doc_id. The members of a band's bucket are tied to its smallest, so a
    bucket of any size gives a row for each member, not for each pair; in each partition that ties make, all documents
    are compared as in the similarity join, so no link depends on the smallest one. Only a pair that no path of shared
    bands connects is missed: a pair of similarity s shares a band with probability 1-(1-s^4)^32, over 0.99 at 0.8.
    """
    ready(docs.sparkSession)
    each = N_HASHES // bands
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).filter("doc_id is not null")

    def cut(batches):
        for b in small(batches):
            sig = signatures(b["text"])
            key = np.ascontiguousarray(sig.astype("<u2")).reshape(len(sig), bands, each).view("<u8").reshape(len(sig), bands).view("<i8")
            sets = arrays.shingle_sets(b["text"])
            some = np.flatnonzero([len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(some)), pa.array([len(sets[i]) for i in some], pa.int64()), pa.array([jaccard._digest(sets[i]) for i in some], pa.binary()), pa.array(list(key[some]), pa.list_(pa.int64()))], ["doc_id", "n", "digest", "keys"])

    told = stored(rows.mapInArrow(cut, "doc_id long, n long, digest binary, keys array<long>"))
    nodes = stored(told.groupBy("digest").agg(F.min("doc_id").alias("label"), F.first("n").alias("n"), F.first("keys").alias("keys")).withColumn("node", F.monotonically_increasing_id()))
    keys = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    lead = keys.groupBy("band", "key").agg(F.min("node").alias("first"), F.count("*").alias("m")).filter("m > 1")
    ties = stored(keys.join(lead, ["band", "key"]).filter("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v")).distinct())
    tied = ties.select("u").union(ties.select("v")).distinct()
    tied = nodes.join(tied, nodes["node"] == tied["u"]).select(F.col("label").alias("_label"), "node", "digest")
    texts = rows.join(tied.hint("shuffle_hash"), F.col("doc_id") == F.col("_label")).select("node", "digest", "text")

    def single(batches):
        for b in batches:
            for ids, sizes, tokens in zip(b["nodes"].to_pylist(), b["sizes"].to_pylist(), b["tokens"].to_pylist()):
                ids, sizes = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
                sets = np.split(np.frombuffer(tokens, np.uint64), np.cumsum(sizes)[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sizes), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([[int(jaccard.arrays.mix(s ^ np.uint64(x)).min().view(np.int64)) for x in jaccard.SEEDS] for s in sets], pa.list_(pa.int64()))], ["node", "n", "tokens", "least"])

    percent = round(100 * threshold, 9)
    sets = stored(jaccard.load_sets(texts).mapInArrow(single, "node long, n long, tokens binary, least array<long>").dropDuplicates(["node"]))
    first = stored(jaccard.near_copies(sets, percent))
    clusters = components(first.select("u", "v"))
    held = stored(sets.join(clusters, sets["node"] == clusters["v"], "left").select("node", "n", F.coalesce("root", "node").alias("cluster"), "tokens"))
    links = stored(first.unionByName(jaccard.compare(held, ties, percent)))
    name = nodes.select("node", "label")
    ends = links.join(name.select(F.col("node").alias("u"), F.col("label").alias("a")), "u").join(name.select(F.col("node").alias("v"), F.col("label").alias("b")), "v")
    same = told.join(nodes.select("digest", "label"), "digest").filter("doc_id <> label").select(F.col("doc_id").alias("a"), F.col("label").alias("b"), F.lit(1.0).alias("jaccard"))
    links = stored(ends.select("a", "b", "jaccard").unionByName(same))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard")).filter("a <> b")
    best = both.groupBy(F.col("a").alias("doc_id")).agg(F.min(F.struct("b", "jaccard")).alias("m"))
    classes = components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("v").alias("doc_id"), F.col("root").alias("class_id"))
    return best.join(classes, "doc_id").select("doc_id", F.col("m.b").alias("leader"), F.col("m.jaccard").alias("jaccard"), "class_id")
