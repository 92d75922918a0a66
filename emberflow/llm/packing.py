"""Packing by first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

A document's ids (its tokens, then the end id) are cut into full sequences and a rest. Groups are drawn by hash, so
they hold like mixtures of lengths, have a bounded size and are packed apart from each other.

Cases: a null or empty text is the end id alone; an empty table gives no rows; rows with the same doc_id are packed
each (they differ in sequence and offset); equal lengths are packed in order of doc_id, start and checksum.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberflow.llm.common import key_text, parts, ready, small, text_of
from emberflow.llm.tokens import encoder

#: Documents that a group has on average.
GROUP = 6000


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; items must be sorted, longest first, none longer than capacity.

    The tree's leaves are bins and each node holds the largest room below it: the leftmost bin with room for an
    item is found by one descent from the root.
    """
    n = len(lengths)
    size = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * size)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i, x in enumerate(lengths.tolist()):
        at = 1
        while at < size:
            at = 2 * at if room[2 * at] >= x else 2 * at + 1
        bins[i], offsets[i] = at - size, capacity - room[at]
        room[at] -= x
        at >>= 1
        while at:
            best = room[2 * at] if room[2 * at] >= room[2 * at + 1] else room[2 * at + 1]
            if room[at] == best:
                break
            room[at] = best
            at >>= 1
    return bins, offsets


def document_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, n_groups: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and the group of every piece. Each text is encoded once."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        enc = encoder(path)
        for b in small(batches):
            out: dict[tuple, int] = {}
            for i, ids in zip(b["doc_id"].to_pylist(), enc.encode(b["text"].to_pylist())):
                ids += end
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    e = min(n, s + capacity)
                    piece = (i, s, e - s, zlib.crc32(ids[4 * s : 4 * e]), n)
                    out[piece] = out.get(piece, 0) + 1
            cols = list(zip(*[(*x, m) for x, m in out.items()])) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b["doc_id"].type), *[pa.array(c, pa.int64()) for c in cols[1:]]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "copies"])

    pieces = docs.select("doc_id", text_of().alias("text")).mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, copies long")
    what = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    # Copies of a row are counted before they are told apart by number, so groups don't follow file splits.
    once = pieces.groupBy(*what).agg(F.sum("copies").alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    named = F.concat_ws(":", key_text(), *[F.col(c).cast("string") for c in ("start", "ids_crc32", "doc_tokens", "copy")])
    return once.select(*what, F.pmod(F.crc32(F.encode(named, "UTF-8")), F.lit(n_groups)).alias("pack_group"))


def pack(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 4096) -> DataFrame:
    """A row for each piece with its sequence_id and offset there."""
    ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = document_pieces(docs, path, end_id, capacity, parts(docs.count(), GROUP))

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        ids = (group["pack_group"].to_numpy() << 32) + bins
        return group.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    return pieces.groupBy("pack_group").applyInArrow(fill, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
