"""Repeated passages found by bucket-pointer refinement of suffixes, spread over Spark.

To be found is every place (a document and a byte) whose next `length` bytes also start at another place. Places are
sorted into buckets of equal beginnings, first by their q-gram, then ever finer: the bucket of a 2h-gram is named by the
pair of the buckets of its first h bytes and of the h bytes from the later offset h, so each refinement reuses the names
that the one before has made. A name is a 64-bit digest of that pair and not a rank in one array, so it is made where the
text is; what has to be asked of all texts is which buckets hold more than one place. Places alone in a bucket are
settled and take no part in what follows.

Not every place is sorted at first. A window (the `length` bytes from a place) is owned by its least q-gram, which equal
windows share at the same offset. Neighbouring windows of one owner form a unit, cut at fixed offsets from the owner; all
windows of a unit hold one core of length - step + 1 bytes. A round sorts units by their core:

  * a core that stands in one place only: none of the windows is repeated;
  * one that stands in several, with the same bytes around it in each: all windows of these units are;
  * else the units are cut into smaller ones, with longer cores, for the next round. The last has single windows.

Names of cores and of whole units come from two families of digests; at the end a window is told by both, 128 bits.
Texts lie in blocks. A block asks for each of its cores once however often it holds it, with the number of places, and
counts are added up before they are shuffled, so a passage in a third of all documents is a row a block. A document is
done, and its text left out of later rounds, when none of its units is open.

Cases: a null text is empty; texts shorter than `length` have nothing to remove; matches may overlap, also themselves
(a run of one letter goes); cuts may fall inside a code point, as bytes are judged; a null doc_id is kept; rows with one
doc_id are separate documents; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberflow.llm import arrays
from emberflow.llm.arrays import press, unpress
from emberflow.llm.common import ready, small, stored, text_of

_U = np.uint64
Q = 25
#: Bytes of text in a block, and of a stretch that is worked on at once.
BLOCK, STRETCH = 1 << 22, 1 << 20
NONE = -(2**63)
#: A second family of digests: other values for the bytes.
_OTHER = np.random.default_rng(400).integers(1, 2**64 - 1, 256, dtype=_U)
_FIRST = np.random.default_rng(25).integers(1, 2**64 - 1, 256, dtype=_U)

STATE = "block long, ids binary, sizes binary, text binary, units binary, marks binary, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"
ASKED = "core long, s long, block long, n long"


def refine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of buckets from those of two parts."""
    return arrays.mix(a * arrays._STEP + b)


class Names:
    """Names of the buckets that places of a stretch of bytes are in."""

    def __init__(self, data: np.ndarray, family: np.ndarray):
        self.power, self.inverse = arrays._powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, _U)
        np.cumsum(family[data] * self.power[: len(data)], out=self.total[1:])

    def grams(self, at: np.ndarray, q: int) -> np.ndarray:
        """Of their q-grams."""
        return arrays.mix((self.total[at + q] - self.total[at]) * self.inverse[at])

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        """Of their first `length` bytes, by the names at later offsets."""
        if length <= Q:
            return self.grams(at, length)
        h = Q
        while 2 * h < length:
            h *= 2
        return refine(self.of(at, h), self.of(at + (length - h), h))


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w values in a row."""
    n, rows = len(x), -(-len(x) // w)
    full = np.full(rows * w, _U(2**64 - 1))
    full[:n] = x
    full = full.reshape(rows, w)
    fore = np.minimum.accumulate(full, 1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], fore[w - 1 : n])


def owned(data: np.ndarray, offs: np.ndarray, length: int) -> np.ndarray:
    """Runs of windows of one owner, as rows: first window, last window, owner."""
    q, out = min(Q, length), []
    for a in range(0, max(0, len(data) - length + 1), STRETCH):
        part = data[a : a + STRETCH + length - 1]
        grams = Names(part, _FIRST).grams(np.arange(len(part) - q + 1), q)
        # The name's upper bits, then the place: of equal names the first wins, and a place is below 2^21.
        own = (_least(grams >> _U(21) << _U(21) | np.arange(len(grams), dtype=_U), length - q + 1) & _U(2**21 - 1)).astype(np.int64)
        at = np.arange(len(own)) + a
        inside = at + length <= offs[np.searchsorted(offs, at, "right")]
        at, own = at[inside], own[inside] + a
        if len(at):
            # An owner of two runs of windows (of two documents) is cut where the windows aren't next to each other.
            begin = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]))
            out.append(np.stack([at[begin], at[np.concatenate([begin[1:], [len(at)]]) - 1], own[begin]]))
    return np.concatenate(out, 1) if out else np.zeros((3, 0), np.int64)


def split(units: np.ndarray, step: int) -> np.ndarray:
    """Units cut where the offset from window to owner is a multiple of step; a fourth row has that multiple."""
    first, last, own = units
    low, high = own - last, own - first
    m = high // step - low // step + 1
    at = np.repeat(np.arange(len(m)), m)
    k = low[at] // step + arrays._ramp(m)
    low, high = np.maximum(low[at], k * step), np.minimum(high[at], k * step + step - 1)
    out = np.stack([own[at] - high, own[at] - low, own[at], k])
    return out[:, np.argsort(out[0], kind="stable")]


def named(data: np.ndarray, units: np.ndarray, step: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of cores and of whole units (bytes and place of the windows around the owner)."""
    core, whole = np.zeros((2, units.shape[1]), _U)
    cuts = np.searchsorted(units[0], np.arange(0, len(data) + STRETCH, STRETCH))
    for j, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
        if x == y:
            continue
        base = j * STRETCH
        part = data[base : base + STRETCH + 2 * length]
        first, last, own, k = units[:, x:y] - np.array([[base], [base], [base], [0]])
        core[x:y] = refine(Names(part, _FIRST).of(own - k * step, length - step + 1), k.astype(_U))
        other = Names(part, _OTHER)
        whole[x:y] = refine(other.of(first, length), _U(0) + (own - first).astype(_U))
        if step > 1:
            whole[x:y] = refine(whole[x:y], refine(other.of(last, length), (own - last).astype(_U)))
    return core, whole


class Block:
    """Documents that aren't done: ids, bytes, open units and what is known to be repeated."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, offs: np.ndarray, units: np.ndarray, marks: np.ndarray):
        self.ids, self.data, self.offs, self.units, self.marks = ids, data, offs, units, marks

    @staticmethod
    def read(row: dict) -> Block:
        offs = np.concatenate([[0], np.cumsum(unpress(row["sizes"], np.int64))])
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"]), np.uint8)
        first, more, own = unpress(row["units"], np.int64).reshape(3, -1)
        first = np.cumsum(first)
        return Block(unpress(row["ids"], np.int64), data, offs, np.stack([first, first + more, first + own]), unpress(row["marks"], np.int64).reshape(2, -1))

    def rows(self, block: int) -> list[dict]:
        """The documents that are done, and a row for the rest."""
        row_of = lambda at: np.searchsorted(self.offs, at, "right") - 1
        still = np.zeros(len(self.ids), bool)
        still[row_of(self.units[0])] = True
        edge = np.zeros(len(self.data) + 1, np.int64)
        np.add.at(edge, self.marks[0], 1)
        np.add.at(edge, self.marks[1], -1)
        covered = np.cumsum(edge[:-1]) > 0
        out = []
        for i in np.flatnonzero(~still):
            x, y = self.offs[i], self.offs[i + 1]
            mine, data = covered[x:y], self.data[x:y]
            turn = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
            kept = data[~mine] if len(turn) else data
            out.append({"doc_id": None if self.ids[i] == NONE else int(self.ids[i]), "n_bytes": int(y - x), "n_removed": int(y - x) - len(kept), "n_spans": len(turn) // 2, "kept_sha256": hashlib.sha256(kept.tobytes()).hexdigest(), "spans": [{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)]})
        if still.any():
            size = np.diff(self.offs)
            moved = np.concatenate([[0], np.cumsum(np.where(still, size, 0))])[:-1] - self.offs[:-1]
            first, last, own = self.units + moved[row_of(self.units[0])]
            marks = self.marks[:, still[row_of(self.marks[0])]]
            marks = marks + moved[row_of(marks[0])]
            units = np.stack([np.diff(first, prepend=0), last - first, own - first])
            text = zstandard.ZstdCompressor(level=6).compress(self.data[np.repeat(still, size)].tobytes())
            out.append({"block": block, "ids": press(self.ids[still]), "sizes": press(size[still]), "text": text, "units": press(units.ravel()), "marks": press(marks.ravel())})
        return out


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema)


def _schema() -> pa.Schema:
    binary = [(c, pa.binary()) for c in ("ids", "sizes", "text", "units", "marks")]
    counts = [(c, pa.int64()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")]
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.schema([("block", pa.int64()), *binary, *counts, ("kept_sha256", pa.string()), ("spans", spans)])


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes) and spans (of what is removed, in bytes)
    of every document, judged on the input as it is."""
    if length < 2:
        raise ValueError("length must be at least 2")
    ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    schema = _schema()
    windows = length - min(Q, length) + 1
    steps = sorted({max(1, windows // 2), max(1, windows // 19), 1}, reverse=True)

    def cut(batches):
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held, size = [], 0

        def out():
            ids = np.concatenate([x for x, _ in held])
            data, offs = arrays.raw(pa.chunked_array([t for _, t in held]).combine_chunks())
            return _table(Block(ids, data, offs, owned(data, offs, length), np.zeros((2, 0), np.int64)).rows(number), schema).to_batches()

        for b in small(batches):
            for at, part in arrays.pieces(b["text"], BLOCK):
                held.append((b["doc_id"].slice(at, len(part)).fill_null(NONE).to_numpy(), part.cast(pa.large_string())))
                size += part.nbytes
                if size >= BLOCK:
                    yield from out()
                    number, held, size = number + 1, [], 0
        if held:
            yield from out()

    def asks(step: int):
        def ask(batches):
            for b in batches:
                for row in b.to_pylist():
                    block = Block.read(row)
                    core, whole = named(block.data, split(block.units, step), step, length)
                    order = np.lexsort((whole, core))
                    core, whole = core[order], whole[order]
                    begin = np.flatnonzero(np.concatenate([[True], (core[1:] != core[:-1]) | (whole[1:] != whole[:-1])]))
                    n = np.diff(np.concatenate([begin, [len(core)]]))
                    t = pa.table([core[begin].view(np.int64), whole[begin].view(np.int64), np.full(len(n), row["block"]), n], ["core", "s", "block", "n"])
                    yield from t.to_batches(max_chunksize=1 << 15)

        return ask

    def settles(step: int):
        def settle(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return _table([], schema)
            row = left.to_pylist()[0]
            block = Block.read(row)
            units = split(block.units, step)
            core, whole = named(block.data, units, step, length)
            core, whole = core.view(np.int64), whole.view(np.int64)
            cores, s, same = (right[c].to_numpy() for c in ("core", "s", "same"))
            order = np.argsort(cores, kind="stable")
            cores, s, same = cores[order], s[order], same[order]
            lo, hi = np.searchsorted(cores, core), np.searchsorted(cores, core, "right")
            found = lo < hi
            if step > 1:
                full = found.copy()
                full[found] = same[lo[found]]
            else:  # Single windows are told by both names; two with the same core are next to never different.
                full = np.zeros(len(core), bool)
                for k in range(int((hi - lo).max(initial=0))):
                    at = np.flatnonzero(lo + k < hi)
                    full[at] |= s[lo[at] + k] == whole[at]
                found = full
            marks = np.concatenate([block.marks, units[:2, full] + np.array([[0], [length]])], 1)
            # Runs that touch are one; what lies in another is left out.
            marks = marks[:, np.argsort(marks[0], kind="stable")]
            if marks.shape[1]:
                reach = np.maximum.accumulate(marks[1])
                doc = np.searchsorted(block.offs, marks[0], "right")
                begin = np.flatnonzero(np.concatenate([[True], (marks[0][1:] > reach[:-1]) | (doc[1:] != doc[:-1])]))
                marks = np.stack([marks[0][begin], reach[np.concatenate([begin[1:], [len(reach)]]) - 1]])
            return _table(Block(block.ids, block.data, block.offs, units[:3, found & ~full], marks).rows(row["block"]), schema)

        return settle

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    state = stored(rows.mapInArrow(cut, STATE))
    done = [state.filter("block is null").select(names)]
    for step in steps:
        blocks = state.filter("block is not null")
        if blocks.isEmpty():
            break
        asked = blocks.select("block", "ids", "sizes", "text", "units", "marks").mapInArrow(asks(step), ASKED)
        if step > 1:
            told = asked.groupBy("core").agg(F.sum("n").alias("m"), (F.min("s") == F.max("s")).alias("same")).filter("m > 1").select("core", "same")
            replies = asked.select("core", "block").join(told, "core").select("block", "core", F.lit(0).cast("long").alias("s"), "same")
        else:
            told = asked.groupBy("core", "s").agg(F.sum("n").alias("m")).filter("m > 1").select("core", "s")
            replies = asked.select("core", "s", "block").join(told, ["core", "s"]).select("block", "core", "s", F.lit(True).alias("same"))
        state = stored(blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(settles(step), STATE))
        done.append(state.filter("block is null").select(names))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
