"""Fill-in-the-middle: texts cut at line ends and put together again with the middle last.

A table-driven automaton reads the bytes of many texts at once. Its state is what of a sentinel has just been read; a
transition (state, class of byte) gives the next state and what is to be counted: the start of a code point (any byte
that continues none), the end of a line, the end of a sentinel. The bytes are dealt into lanes that step together; a
state depends on the two bytes before alone, so a lane that begins inside a text reads these two first. The one scan gives
the counts of each text, and a second pass finds the bytes where the drawn lines end.

Draws: h1 to h4 are the first four groups of eight digits of sha256("<seed>:<doc_id>"). With n lines, the prefix ends
after the smaller of h1 % (n + 1) and h2 % (n + 1) lines and the middle after the larger. h3 % 100 >= rate leaves a text
plain; h4 % 100 < spm_rate puts the suffix first.

Cases: a null text is the empty one, which stays plain, as does a text that holds a sentinel; a null doc_id is drawn for
as "null"; rows with one doc_id are drawn for alike, each for its own number of lines; a text without a line end is one
line; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberflow.llm import arrays
from emberflow.llm.common import ready, small, text_of

#: Marks of the three parts, in the order prefix, suffix, middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Classes of bytes: others, "<", the letters of sentinels, ">", the line end, and bytes that continue a code point.
OTHER, OPEN, LETTER, CLOSE, LINE, INNER = range(6)
#: What a transition counts.
CHAR, END_LINE, END_SENTINEL = 1, 2, 4
#: Bytes of a lane, and bytes before it that settle its first state.
LANE, BEFORE = 512, 2


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each byte; next state and counts by 8 * state + class. States: nothing, "<" read, "<" and a letter read."""
    kind = np.full(256, OTHER, np.uint8)
    kind[0x80:0xC0] = INNER
    for c, k in (("<", OPEN), ("P", LETTER), ("S", LETTER), ("M", LETTER), (">", CLOSE), ("\n", LINE)):
        kind[ord(c)] = k
    step, emit = np.zeros(24, np.uint8), np.zeros(24, np.uint8)
    for state in range(3):
        for k in range(6):
            step[8 * state + k] = 1 if k == OPEN else 2 if (state, k) == (1, LETTER) else 0
            emit[8 * state + k] = (k != INNER) * CHAR | (k == LINE) * END_LINE | ((state, k) == (2, CLOSE)) * END_SENTINEL
    return kind, step, emit


_KIND, _STEP, _EMIT = _tables()


def scan(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """What each byte counts, for the bytes of rows that begin at offs."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint8)
    lanes = -(-n // LANE)
    kind = np.zeros(BEFORE + lanes * LANE, np.uint8)
    kind[BEFORE : BEFORE + n] = _KIND[data]
    # A row's first byte finds no sentinel begun: 128 is added to its class.
    kind[BEFORE + offs[:-1][offs[:-1] < n]] |= 128
    by_step = np.lib.stride_tricks.as_strided(kind, (lanes, LANE + BEFORE), (LANE, 1)).T
    out = np.empty((LANE, lanes), np.uint8)
    state = np.zeros(lanes, np.uint8)
    for j in range(LANE + BEFORE):
        k = by_step[j]
        state[k > 127] = 0
        at = state * 8 + (k & 127)
        state = _STEP[at]
        if j >= BEFORE:
            out[j - BEFORE] = _EMIT[at]
    return np.ascontiguousarray(out.T).ravel()[:n]


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many bytes of each row are flagged."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offs])


def draws(key: str, seed: int) -> list[int]:
    digits = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digits[k : k + 8], 16) for k in range(0, 32, 8)]


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output of every text.

    psm is <P>prefix<S>suffix<M>middle, spm is <S>suffix<P>prefix<M>middle.
    """
    ready(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("key"), text_of().alias("text"))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    p, s, m = (x.encode() for x in SENTINELS)

    def turn(batches):
        for b in small(batches):
            for at, texts in arrays.pieces(b["text"]):
                own = b.slice(at, len(texts))
                data, offs = arrays.raw(texts)
                flags = scan(data, offs)
                ends = np.flatnonzero(flags & END_LINE) + 1
                chars = np.concatenate([[0], np.cumsum(flags & CHAR)])
                first = np.searchsorted(ends, offs, "right")  # of each row, the first of its line ends
                closed = np.diff(first)
                size = np.diff(offs)
                open_end = (size > 0) & ~np.isin(offs[1:], ends)
                n = closed + open_end
                marks = _sums(flags & END_SENTINEL > 0, offs)
                raw, out = data.tobytes(), []
                for i, key in enumerate(own["key"].to_pylist()):
                    x, y = int(offs[i]), int(offs[i + 1])
                    h = draws(key, seed)
                    if x == y or marks[i] or h[2] % 100 >= rate:
                        out.append((int(n[i]), "plain", None, None, raw[x:y].decode()))
                        continue
                    units = int(n[i]) + 1
                    lines = sorted((h[0] % units, h[1] % units))
                    # The second pass: the byte after line k of this row; the last may lack its line end.
                    cuts = [x if k == 0 else y if k == n[i] else int(ends[first[i] + k - 1]) for k in lines]
                    a, c, z = raw[x : cuts[0]], raw[cuts[0] : cuts[1]], raw[cuts[1] : y]
                    form = "spm" if h[3] % 100 < spm_rate else "psm"
                    text = s + z + p + a + m + c if form == "spm" else p + a + s + z + m + c
                    out.append((int(n[i]), form, int(chars[cuts[0]] - chars[x]), int(chars[cuts[1]] - chars[cuts[0]]), text.decode()))
                cols = [pa.array(v, k) for v, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays([own["doc_id"], *cols], ["doc_id", *names])

    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(turn, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from."""
    part = F.split(output, "|".join(SENTINELS), -1)
    whole = lambda *ix: F.concat(*[part[i] for i in ix])
    return F.when(form == "psm", whole(1, 3, 2)).when(form == "spm", whole(2, 3, 1)).otherwise(output)
