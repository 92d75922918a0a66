"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (P) and unlabelled ones (U) train a linear numpy model on the risk

    pi * E_P[l(+z)] + max(0, E_U[l(-z)] - pi * E_P[l(-z)]),    l(z) = log(1 + exp(-z)),

where pi is the class prior; when the second part falls below zero, its own gradient is climbed instead. Features
are the presence of words and of word beginnings, by hash; those that tell P from U best are kept.

Fitting takes every document and label. Features are chosen by counts over all; documents are then dealt by hash into
groups of some `each` rows, a task a group, and weights are the mean of the groups' weights. A positive goes to one group, or
to as many as give each SOME_POSITIVE of them. The weight of the penalty on large weights is chosen with the same means:
models fitted on one half of all documents are held against all labels of the other half. Scoring takes every document
whole. Cases: a null text is the empty one and gets the bias's score; without positives all scores are the prior; repeated
labels count as toxic if one says so; null keys and null labels never train; of equal penalties the smallest stands; an
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberflow.llm import arrays
from emberflow.llm.common import free_name, parts, ready, small, stored, text_of

BITS = 20
#: A feature is kept if so many positives have it and its rates differ by so many standard errors.
LEAST, GAIN = 3, 2.5
PREFIXES = (4, 5, 6)
#: Penalties to choose from, halves that each is tried on, and the score from which a text counts as toxic there.
DECAYS, HALVES, THRESHOLD = (1e-4, 1e-3, 5e-3, 2e-2), 2, 0.7
#: Positives that a group has at least, if there are as many.
SOME_POSITIVE = 1000


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word and beginning, with repeats; features are below 2**BITS."""
    rows, found = [], []
    for at, part in arrays.pieces(texts):
        h, ptr, heads = arrays.words(part, PREFIXES)
        row = np.repeat(np.arange(len(ptr) - 1) + at, np.diff(ptr))
        for x in (h, *heads):
            rows.append(row)
            found.append((x >> np.uint64(64 - BITS)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class Model:
    """Feature ids in order, their weights and the bias."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        table = np.full(1 << BITS, -1, np.int32)
        table[self.ids] = np.arange(len(self.ids))
        z = np.full(len(texts), self.bias)
        row, f = features(texts)
        col = table[f]
        hit = col >= 0
        pair = np.unique(row[hit] * max(1, len(self.ids)) + col[hit])
        if len(pair):
            np.add.at(z, pair // len(self.ids), self.weights[pair % len(self.ids)])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risk(w: np.ndarray, pos: np.ndarray, unl: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk for weights w, the bias last: pi * E_P[l(+z)] and E_U[l(-z)] - pi * E_P[l(-z)]."""
    zp, zu = pos @ w[:-1].astype(pos.dtype) + w[-1], unl @ w[:-1].astype(pos.dtype) + w[-1]
    loss = lambda z: np.logaddexp(0, -z).mean()
    return float(prior * loss(zp)), float(loss(-zu) - prior * loss(-zp))


def gradient(w: np.ndarray, pos: np.ndarray, unl: np.ndarray, prior: float) -> np.ndarray:
    """Of the sum of both parts of the risk, or against the second part's own where that is negative."""
    zp, zu = pos @ w[:-1].astype(pos.dtype) + w[-1], unl @ w[:-1].astype(pos.dtype) + w[-1]
    mean = lambda x, c: np.append(c.astype(x.dtype) @ x, c.sum()) / len(c)
    # Gradients of E_P[l(+z)], E_P[l(-z)] and E_U[l(-z)].
    up, down_p, down_u = mean(pos, -_sigmoid(-zp)), mean(pos, _sigmoid(zp)), mean(unl, _sigmoid(zu))
    second = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    return prior * up + down_u - prior * down_p if second >= 0 else prior * down_p - down_u


def train_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias from 0/1 matrices of positive and unlabelled rows, by Adam on the non-negative risk.

    Each step takes all rows: in small batches the second part of the risk falls below zero by chance, and climbing
    it then would draw all scores together.
    """
    w = np.zeros(pos.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = gradient(w, pos, unl, prior)
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _dense(rows: list[bytes], n: int) -> np.ndarray:
    x = np.zeros((len(rows), n), np.float32)
    for i, c in enumerate(rows):
        x[i, np.frombuffer(c, "<u2")] = 1
    return x


class Sparse:
    """A 0/1 matrix by its ones, multiplied by a vector from either side in one thread."""

    dtype, __array_ufunc__ = np.dtype(np.float64), None

    def __init__(self, row: np.ndarray, col: np.ndarray, shape: tuple[int, int]):
        self.shape = shape
        self._rows, self._cols = self._runs(row, col, shape[0]), self._runs(col, row, shape[1])

    @staticmethod
    def _runs(key: np.ndarray, other: np.ndarray, n: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        ends = np.searchsorted(key[order], np.arange(n + 1))
        filled = np.flatnonzero(np.diff(ends))
        return n, filled, ends[filled], other[order]

    @staticmethod
    def _sum(runs: tuple[int, np.ndarray, np.ndarray, np.ndarray], w: np.ndarray) -> np.ndarray:
        n, filled, begin, other = runs
        out = np.zeros(n)
        if len(filled):
            out[filled] = np.add.reduceat(w[other], begin)
        return out

    def __len__(self) -> int:
        return self.shape[0]

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return self._sum(self._rows, w)

    def __rmatmul__(self, c: np.ndarray) -> np.ndarray:
        return self._sum(self._cols, c)


def _sparse(rows: list[bytes], n: int) -> Sparse:
    found = [np.frombuffer(c, "<u2") for c in rows]
    col = np.concatenate([*found, np.zeros(0, "<u2")]).astype(np.int64)
    return Sparse(np.repeat(np.arange(len(rows)), [len(c) for c in found]), col, (len(rows), n))


#: Models that are fitted together to choose by: each penalty without each half.
_DECAY, _WITHOUT = np.repeat(DECAYS, HALVES), np.tile(np.arange(HALVES), len(DECAYS))


def group_models(rows: DataFrame, n_features: int, prior: float, n_pos: int, n_unl: int, each: int, decays: np.ndarray, without: np.ndarray, steps: int) -> np.ndarray:
    """Weights and, last, bias of each model (columns; its penalty and the half that it leaves out, HALVES for none), the
    means over groups of rows (p, half, c: feature numbers)."""
    groups = parts(n_unl, each)
    copies = min(groups, parts(min(n_pos, SOME_POSITIVE) * groups, n_pos))
    own = F.pmod(F.hash("doc_id", "c"), F.lit(groups))
    unl = rows.select(own.alias("group"), F.lit(0).alias("p"), "half", "c")
    pos = rows.filter("p = 1").select(F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("i"), own.alias("own"), "half", "c")
    pos = pos.select(F.pmod(F.col("own") + F.col("i"), F.lit(groups)).alias("group"), F.lit(1).alias("p"), "half", "c")

    def train(part: pa.Table) -> pa.Table:
        part = part.sort_by([("half", "ascending"), ("c", "ascending")])
        p, half, w = part["p"].to_numpy() == 1, part["half"].to_numpy(), []
        for k in np.unique(without):
            pos, unl = (_sparse(part.filter(pa.array(mine & (half != k)))["c"].to_pylist(), n_features) for mine in (p, ~p))
            # A group that lacks the rows for a model takes no part in its mean.
            for i in np.flatnonzero(without == k) if len(pos) and len(unl) else ():
                w.append((i, np.append(*train_nnpu(pos, unl, prior, steps, decay=decays[i])).tobytes()))
        model, w = zip(*w) if w else ((), ())
        return pa.table({"group": pa.array([part["group"][0].as_py()] * len(w), pa.int32()), "model": pa.array(model, pa.int32()), "w": pa.array(w, pa.binary())})

    def mean(part: pa.Table) -> pa.Table:
        w = np.mean([np.frombuffer(v) for v in part.sort_by("group")["w"].to_pylist()], 0)
        return pa.table({"model": part["model"][:1], "w": pa.array([w.tobytes()], pa.binary())})

    each_group = unl.unionByName(pos).repartition(groups, "group").groupBy("group").applyInArrow(train, "group int, model int, w binary")
    got = each_group.groupBy("model").applyInArrow(mean, "model int, w binary").collect()  # a fixed number of models
    return np.stack([np.frombuffer(r["w"]) for r in sorted(got, key=lambda r: r["model"])], 1)


def chosen_decay(rows: DataFrame, w: np.ndarray) -> float:
    """The penalty with the least share of missed toxic and flagged clean rows over the halves, of all rows (p, y, half, c)."""
    shared = rows.sparkSession.sparkContext.broadcast(w)  # a fixed number of models

    def count(batches):
        w = shared.value
        n = np.zeros((len(_DECAY), 2, 2), np.int64)
        for b in small(batches):
            over = _dense(b["c"].to_pylist(), len(w) - 1) @ w[:-1].astype(np.float32) + w[-1] >= np.log(THRESHOLD / (1 - THRESHOLD))
            own = b["half"].to_numpy()[:, None] == _WITHOUT
            for toxic, mine in ((1, b["p"].to_numpy() == 1), (0, b["y"].to_numpy() == 0)):
                mine = own & mine[:, None]
                n[:, toxic] += np.stack([mine.sum(0), (mine & (over != bool(toxic))).sum(0)], 1)
        yield pa.RecordBatch.from_arrays([pa.array(v.ravel()) for v in (*np.indices((len(_DECAY), 2)), n[:, :, 0], n[:, :, 1])], ["model", "toxic", "n", "wrong"])

    told = rows.mapInArrow(count, "model long, toxic long, n long, wrong long").groupBy("model", "toxic").agg(F.sum("wrong").alias("wrong"), F.sum("n").alias("n"))
    error = np.zeros(len(_DECAY))
    for r in told.collect():  # two rows a model
        error[r["model"]] += r["wrong"] / max(1, r["n"])
    errors = {d: round(float(error[_DECAY == d].sum()), 9) for d in DECAYS}
    return min(DECAYS, key=lambda d: (errors[d], d))


def fit(docs: DataFrame, labels: DataFrame, n_features: int = 1024, each: int = 10_000) -> Model:
    """docs and labels hold only rows that may be learnt from, and all of them are; labels: doc_id, toxic. each: rows of
    a group that is fitted in one task."""
    spark = ready(docs.sparkSession)
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    n, n_toxic = marked.agg(F.count("*"), F.sum("y")).first()
    prior = min(0.5, max(0.005, (n_toxic or 0) / max(1, n)))
    docs = docs.filter("doc_id is not null").select("doc_id", text_of().alias("text"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(HALVES)).cast("int")

    def with_labels(df: DataFrame) -> DataFrame:
        y = F.coalesce("y", F.lit(-1))
        return df.join(marked, "doc_id", "left").select(*df.columns, y.alias("y"), (y == 1).cast("int").alias("p"), half.alias("half"))

    def count(batches):
        total = np.zeros((2, 1 << BITS), np.int64)
        for b in small(batches):
            row, f = features(b["text"])
            pair = np.unique(row << BITS | f)
            p = b["p"].to_numpy()[pair >> BITS]
            f = pair & ((1 << BITS) - 1)
            total[0] += np.bincount(f, minlength=1 << BITS)
            total[1] += np.bincount(f[p == 1], minlength=1 << BITS)
        f = np.flatnonzero(total[0])
        for i in range(0, len(f), 65536):
            g = f[i : i + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(total[1][g]), pa.array(total[0][g])], ["f", "p", "u"])

    halves = with_labels(docs.select("doc_id")).groupBy("half").agg(F.sum("p").alias("p"), F.count("*").alias("u"), F.count_if(F.col("y") == 0).alias("clean")).collect()
    n_pos, n_unl = (sum(r[c] for r in halves) for c in ("p", "u"))
    if not n_pos or not n_unl:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    rate_p, rate_u = (F.col("p") + 0.5) / (n_pos + 1), (F.col("u") + 0.5) / (n_unl + 1)
    gain = F.abs(rate_p - rate_u) / F.sqrt(rate_p / n_pos + rate_u / n_unl)
    counts = with_labels(docs).select("text", "p").mapInArrow(count, "f long, p long, u long")
    best = counts.groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).withColumn("g", gain).filter(f"p >= {LEAST} and g > {GAIN}").orderBy(F.desc("g"), "f").limit(n_features)
    ids = np.sort(np.array([r["f"] for r in best.select("f").collect()], np.int64))

    def project(batches):
        table = np.full(1 << BITS, -1, np.int32)
        table[ids] = np.arange(len(ids))
        for b in small(batches):
            row, f = features(b["text"])
            hit = table[f] >= 0
            pair = np.unique(row[hit] * len(ids) + table[f][hit])
            cut = np.searchsorted(pair // max(1, len(ids)), np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([(pair[x:y] % len(ids)).astype("<u2").tobytes() for x, y in zip(cut[:-1], cut[1:])], pa.binary())], ["doc_id", "c"])

    rows = stored(with_labels(docs.mapInArrow(project, T.StructType([docs.schema["doc_id"], T.StructField("c", T.BinaryType())]))))
    models = lambda *which: group_models(rows, len(ids), prior, n_pos, n_unl, each, *which)
    # Each half must hold confirmed, unlabelled and clean rows, or there is nothing to choose by.
    enough = len(halves) == HALVES and all(r[c] for r in halves for c in ("p", "u", "clean"))
    decay = chosen_decay(rows, models(_DECAY, _WITHOUT, 200)) if enough and len(ids) else DECAYS[0]
    model = models(np.array([decay]), np.array([HALVES]), 400)[:, 0]
    return Model(ids, model[:-1], float(model[-1]))


def score(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """docs with one more column, the chance that the text is toxic, from it alone; where docs have a column of that
    name, the new one's gets underscores after it."""
    name = free_name(docs.columns, name)
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a bounded number of weights

    def run(batches):
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.score(b["text"].cast(pa.large_string())), pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """docs whose score is below the threshold, with their own columns."""
    name = free_name(docs.columns, "_toxicity")
    return score(docs, model, name).filter(F.col(name) < threshold).drop(name)
