"""Language-model scores of documents by sharded Elias-Fano bigram tries.

1. Documents become blocks of a few million words: a dictionary of word hashes and a word number for each token.
2. Vocabulary shards add up the blocks' counts and answer each block with ids and counts of its words.
3. Blocks send their distinct bigrams, with training counts, to the shard of the first word; a word with very many
   tokens is split over several shards by the second. A shard adds up, builds its trie and looks the blocks' bigrams
   up there; it answers with 8-bit codes and with the mass that discounting freed for each context.
4. Blocks put the answers together: p(w|v) = max(c(v,w) - D, 0) / c(v) + freed(v) / c(v) * p1(w), where
   p1(w) = (c(w) - D1) / N for known words and D1 * V / N for the one unknown word.

Only distinct words and bigrams of a block are moved, so a word or pair that makes up a third of all tokens weighs
as much as any other. Cases: a null or empty text is the end token alone; without training documents every
probability is 1 for the unknown word; rows with the same doc_id are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberflow.llm import arrays
from emberflow.llm.arrays import press, unpress
from emberflow.llm.common import key_text, parts, ready, small, stored, text_of
from emberflow.llm.ngrams import Trie

_U = np.uint64
#: Words in a block; bigrams that a shard is asked for, about; tokens of a word from which its bigrams are split.
BLOCK, ASKED, SPLIT = 2_000_000, 2_000_000, 1_000_000
START, END = 0, 1


BLOCKS = "block long, ids binary, held binary, sizes binary, tokens binary, words binary, counts binary"
ANSWERS = "block long, kind int, shard int, a binary, b binary, c binary"


def _table(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    spec = [x.split() for x in names.split(", ")]
    cols = list(zip(*rows)) if rows else [[]] * len(spec)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(cols, spec)], [n for n, _ in spec])


def encode_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of docs (doc_id long, held boolean, text)."""

    def encode(batches):
        number = TaskContext.get().partitionId() << 32
        ids, held, sizes, hs, n = [], [], [], [], 0

        def out(number):
            h = np.concatenate([*hs, np.zeros(0, _U)])
            size = np.concatenate(sizes)
            train = np.repeat(~np.concatenate(held), size)
            words, at, count = np.unique(h, return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            learnt = np.bincount(at, train, len(words)).astype(np.uint32)[order]
            # A null doc_id is told by the largest number, which isn't one otherwise seen.
            return _table([(number, press(np.concatenate(ids)), press(np.concatenate(held)), press(size.astype(np.uint32)), press(place[at]), press(words[order]), press(learnt))], BLOCKS)

        for b in small(batches):
            own = b["doc_id"].fill_null(NONE).to_numpy()
            mark = b["held"].to_numpy(zero_copy_only=False)
            for at, part in arrays.pieces(b["text"]):
                h, ptr = arrays.words(part)
                ids.append(own[at : at + len(part)])
                held.append(mark[at : at + len(part)])
                sizes.append(np.diff(ptr))
                hs.append(h)
                n += len(h)
                if n >= BLOCK:
                    yield out(number)
                    number, n = number + 1, 0
                    ids, held, sizes, hs = [], [], [], []
        if ids:
            yield out(number)

    return docs.mapInArrow(encode, BLOCKS)


NONE = -(2**63)


def _runs(rising: np.ndarray):
    """(value, from, to) of each value that occurs: as many as there are, not as there are shards."""
    begin = np.flatnonzero(np.concatenate([[True], rising[1:] != rising[:-1]])) if len(rising) else np.zeros(0, int)
    return zip(rising[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(rising)])


def vocabulary(blocks: DataFrame, shards: int) -> DataFrame:
    """Answers of kind 0 to each block (ids and counts of its words, by shard and hash), and of kind 1 with a
    shard's statistics: distinct words, those seen once and twice, tokens."""

    def ask(batches):
        for b in batches:
            for i in range(b.num_rows):
                w, c = unpress(b["words"][i].as_py(), np.uint64), unpress(b["counts"][i].as_py(), np.uint32)
                shard = (w % _U(shards)).astype(np.int64)
                order = np.lexsort((w, shard))
                rows = [(k, b["block"][i].as_py(), w[order[x:y]].tobytes(), press(c[order[x:y]])) for k, x, y in _runs(shard[order])]
                yield _table(rows, "shard int, block long, w binary, c binary")

    def answer(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        ws = [np.frombuffer(x, np.uint64) for x in group["w"].to_pylist()]
        cs = [unpress(x, np.uint32) for x in group["c"].to_pylist()]
        words, at = np.unique(np.concatenate(ws), return_inverse=True)
        total = np.bincount(at, np.concatenate(cs), len(words)).astype(np.int64)
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(words))
        ids = np.where(total > 0, 2 + rank * shards + shard, 0).astype(np.uint64)
        rows, x = [], 0
        for block, w in zip(group["block"].to_pylist(), ws):
            own = at[x : x + len(w)]
            rows.append((block, 0, shard, press(ids[own]), press(total[own].astype(np.uint64)), b""))
            x += len(w)
        stats = [int(x) for x in ((total > 0).sum(), (total == 1).sum(), (total == 2).sum(), total.sum())]
        rows.append((-1, 1, shard, ",".join(map(str, stats)).encode(), b"", b""))
        return pa.Table.from_batches([_table(rows, ANSWERS)])

    return blocks.select("block", "words", "counts").mapInArrow(ask, "shard int, block long, w binary, c binary").groupBy("shard").applyInArrow(answer, ANSWERS)


class _Block:
    """One block with its answers of kind 0: the distinct known bigrams and the shards they belong to."""

    def __init__(self, left: pa.Table, answers: pa.Table, vocab_shards: int, shards: int, n_train: int):
        self.ids = unpress(left["ids"][0].as_py(), np.int64)
        self.held = unpress(left["held"][0].as_py(), np.bool_)
        self.size = unpress(left["sizes"][0].as_py(), np.uint32).astype(np.int64)
        tokens = unpress(left["tokens"][0].as_py(), np.uint32).astype(np.int64)
        words = unpress(left["words"][0].as_py(), np.uint64)
        shard = (words % _U(vocab_shards)).astype(np.int64)
        order = np.lexsort((words, shard))
        kinds = answers["kind"].to_numpy()
        mine = {answers["shard"][int(i)].as_py(): i for i in np.flatnonzero(kinds == 0)}
        told = [mine[k] for k in sorted(mine)]
        n = len(words)
        # Local words 0..n-1, then the start and the end of a document.
        self.gid, self.count = np.zeros(n + 2, np.uint64), np.zeros(n + 2, np.int64)
        if n:
            self.gid[order] = np.concatenate([unpress(answers["a"][int(i)].as_py(), np.uint64) for i in told])
            self.count[order] = np.concatenate([unpress(answers["b"][int(i)].as_py(), np.uint64) for i in told]).astype(np.int64)
        self.gid[n], self.gid[n + 1] = START, END
        self.count[n:] = n_train
        known = self.count > 0
        ends = np.cumsum(self.size + 1)
        self.begin = ends - self.size - 1
        self.w = np.full(int(ends[-1]) if len(ends) else 0, n + 1, np.int64)
        inner = np.ones(len(self.w), bool)
        inner[ends - 1] = False
        self.w[inner] = tokens
        self.v = np.empty_like(self.w)
        self.v[1:] = self.w[:-1]
        self.v[self.begin] = n
        train = np.repeat(~self.held, self.size + 1)
        both = known[self.v] & known[self.w]
        pair, at, = np.unique(self.v[both] * (n + 2) + self.w[both], return_inverse=True)
        learnt = np.bincount(at, train[both], len(pair)).astype(np.uint32)
        v, w = pair // (n + 2), pair % (n + 2)
        split = 1 + self.count // SPLIT
        home = (arrays.mix(self.gid + _U(1)) % _U(shards)).astype(np.int64)
        to = (home[v] + (arrays.mix(self.gid[w] + _U(7)) % split[v].astype(np.uint64)).astype(np.int64)) % shards
        order = np.lexsort((self.gid[w], self.gid[v], to))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        #: For every token of a known bigram, its place in the order sent.
        self.both, self.at = both, back[at]
        self.pv, self.pw, self.to, self.learnt = v[order], w[order], to[order], learnt[order]
        # Contexts by shard; a split one is asked for in each of its shards.
        # So is one that only unknown words follow here: it frees a share for them all the same.
        ctx = np.unique(self.v[known[self.v]])
        reps = np.minimum(split[ctx], shards)
        cv = np.repeat(ctx, reps)
        cs = (home[cv] + arrays._ramp(reps)) % shards
        order = np.lexsort((self.gid[cv], cs))
        self.cv, self.cs = cv[order], cs[order]

    def cuts(self, k: int) -> tuple[slice, slice]:
        """A shard's part of the contexts and of the bigrams."""
        return slice(*np.searchsorted(self.cs, [k, k + 1])), slice(*np.searchsorted(self.to, [k, k + 1]))


def bigram_answers(blocks: DataFrame, vocab: DataFrame, vocab_shards: int, shards: int, n_train: int) -> DataFrame:
    """Answers of kind 2: codes of a block's bigrams, the mass freed for its contexts, and the codebook."""
    names = "shard int, block long, v binary, cv binary, n binary, w binary, c binary"

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([_table([], names)])
        b = _Block(left, right, vocab_shards, shards, n_train)
        rows = []
        for k, x, y in _runs(b.cs):
            c, p = slice(x, y), b.cuts(k)[1]
            ctx, gv = b.gid[b.cv[c]], b.gid[b.pv[p]]
            n = (np.searchsorted(gv, ctx, "right") - np.searchsorted(gv, ctx, "left")).astype(np.uint32)
            rows.append((k, left["block"][0].as_py(), press(np.diff(ctx, prepend=_U(0))), press(b.count[b.cv[c]].astype(np.uint64)), press(n), press(b.gid[b.pw[p]]), press(b.learnt[p])))
        return pa.Table.from_batches([_table(rows, names)])

    def counts(group: pa.Table):
        """Contexts, their totals, the bigrams by context and successor, their counts, and where each block's are."""
        read = lambda name, kind: [unpress(x, kind) for x in group[name].to_pylist()]
        ctxs = [np.cumsum(x, dtype=np.uint64) for x in read("v", np.uint64)]
        totals, ns, ws, cs = read("cv", np.uint64), read("n", np.uint32), read("w", np.uint64), read("c", np.uint32)
        ctx, at = np.unique(np.concatenate(ctxs), return_inverse=True)
        total = np.zeros(len(ctx), np.uint64)
        total[at] = np.concatenate(totals)
        owner = np.repeat(at, np.concatenate(ns))
        # Ids stay below 2^40; contexts of a shard below 2^24.
        pair, back = np.unique(owner.astype(np.uint64) << _U(40) | np.concatenate(ws), return_inverse=True)
        count = np.bincount(back, np.concatenate(cs), len(pair)).astype(np.int64)
        return ctxs, ns, ctx, at, total, pair, back, count

    def rare(group: pa.Table) -> pa.Table:
        count = counts(group)[-1]
        return pa.table({"once": [int((count == 1).sum())], "twice": [int((count == 2).sum())]})

    def answer(group: pa.Table) -> pa.Table:
        ctxs, ns, ctx, at, total, pair, back, count = counts(group)
        some = count > 0
        c_of, w_of = (pair >> _U(40)).astype(np.int64), pair & _U(2**40 - 1)
        lens = np.bincount(c_of[some], minlength=len(ctx))
        logs = np.log10((count[some] - discount) / total[c_of[some]].astype(np.float64))
        trie = Trie(ctx, np.concatenate([[0], np.cumsum(lens)]), w_of[some], logs)
        codes = trie.lookup(ctx[c_of], w_of)
        freed = (discount * lens).astype(np.float32)
        rows, x, y = [], 0, 0
        for block, c, n in zip(group["block"].to_pylist(), ctxs, ns):
            m = int(n.sum())
            rows.append((block, 2, group["shard"][0].as_py(), press(codes[back[y : y + m]]), press(freed[at[x : x + len(c)]]), trie.book.tobytes()))
            x, y = x + len(c), y + m
        return pa.Table.from_batches([_table(rows, ANSWERS)])

    asked = stored(blocks.groupBy("block").cogroup(vocab.filter("kind = 0").groupBy("block")).applyInArrow(ask, names))
    # One discount for all shards, from the bigrams of all training text seen once and twice.
    once, twice = (x or 0 for x in asked.groupBy("shard").applyInArrow(rare, "once long, twice long").agg(F.sum("once"), F.sum("twice")).first())
    discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
    return asked.groupBy("shard").applyInArrow(answer, ANSWERS)


def score(docs: DataFrame, held_out: int = 2, folds: int = 7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; the model learns from
    those whose crc32(doc_id as text) mod folds isn't held_out."""
    spark = ready(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.crc32(F.encode(key_text(), "UTF-8")) % folds == held_out).alias("held"), text_of().alias("text"))
    n_train = own.filter("not held").count()
    blocks = stored(encode_blocks(own))
    n_rows = docs.count()
    vocab_shards = parts(n_rows, 8000)
    vocab = stored(vocabulary(blocks, vocab_shards))
    # Four numbers a shard, added up in the tasks.
    nums = [F.split(F.decode("a", "UTF-8"), ",")[i].cast("long") for i in range(4)]
    known, once, twice, words = (x or 0 for x in vocab.filter("kind = 1").agg(*[F.sum(x) for x in nums]).first())
    n_tokens, n_words = words + n_train, known + (n_train > 0)
    discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
    shards = parts(max(n_tokens, 1), ASKED)
    answers = stored(bigram_answers(blocks, vocab, vocab_shards, shards, n_train))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        b = _Block(left, right, vocab_shards, shards, n_train)
        known = b.count > 0
        base = np.log10((b.count + 1) / (n_tokens + n_words + 1))
        one = np.where(known, (b.count - discount) / max(1, n_tokens), discount * n_words / max(1, n_tokens)) if n_tokens else np.ones(len(known))
        share = np.zeros(len(b.to))
        freed = np.zeros(len(b.count))
        for i in np.flatnonzero(right["kind"].to_numpy() == 2):
            c, p = b.cuts(right["shard"][int(i)].as_py())
            share[p] = np.frombuffer(right["c"][int(i)].as_py(), np.float32)[unpress(right["a"][int(i)].as_py(), np.uint8)]
            np.add.at(freed, b.cv[c], unpress(right["b"][int(i)].as_py(), np.float32))
        back_off = np.where(freed > 0, np.minimum(1.0, freed / np.maximum(b.count, 1)), 1.0)
        p = back_off[b.v] * one[b.w]
        p[b.both] += share[b.at]
        total = lambda x: np.add.reduceat(x, b.begin)
        cols = [pa.array(b.ids, pa.int64(), mask=b.ids == NONE), pa.array(b.held), pa.array(b.size + 1), pa.array(total(known[b.w].astype(np.int64))), pa.array(np.full(len(b.ids), n_tokens)), pa.array(total(base[b.w])), pa.array(total(np.log10(np.minimum(p, 1.0))))]
        return pa.table(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    both = vocab.filter("kind = 0").unionByName(answers)
    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
