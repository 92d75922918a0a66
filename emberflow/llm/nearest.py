"""Nearest vectors by cosine: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

A unit vector is cut into subspaces of two places, each coded by one of 16 centres. Codes and centres lessen
h_par * |residual along x|^2 + h_perp * |residual across x|^2 with h_par > h_perp, as error along x spoils its inner
products most. Rows lie in leaves, by the nearest of some coarse centres; a query is sent to as many of its nearest
leaves as hold a stated share of the true neighbours in the fitting sample: few where vectors lie in clusters, most where
they lie evenly. A scan adds 4-bit table entries, two codes a byte. A task keeps its k best of each query so far, and
compares exactly, in double precision, only rows whose sum is not below the k-th of these by more than the
quantisation error measured on the sample; so it leaves k rows a query, however many blocks it reads.

Fitting takes at most `max_fit` rows, the first in md5 order of vec_id; every row is coded. Cases: vectors that are
null or zero or that hold null or non-finite places take no part, nor do null vec_ids; a vector of another length than
most is searched, exactly, among those of its own length; magnitudes are scaled by powers of two, so none is too large
or too small; with repeated vec_ids, the nearest counts once as a candidate and the first in array order asks; ties go
to the smaller vec_id; fewer candidates than k are all returned; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberflow.llm.common import lowest, parts, ready, stored

#: Rows in a block, the most in a bucket, queries in a block, pairs compared exactly at once, and query blocks whose
#: best a task keeps.
BLOCK, BUCKET, QUERIES, PAIRS, KEPT = 8192, 1 << 18, 512, 1 << 15, 4096


@dataclass
class Codebook:
    """Centres by subspace, as (subspaces, 16, 2), and the weights of error along and across."""

    centres: np.ndarray
    along: float
    across: float
    #: Coarse centres, how many leaves a query is sent to, and by how much a sum may fall short of the true cosine.
    leaves: np.ndarray | None = None
    probes: int = 1
    margin: float = 0.0

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes of unit vectors: nearest centres first, then each subspace is chosen again under the whole loss."""
        xs = _cut(x, len(self.centres))
        codes = np.stack([((xs[:, m, None] - c) ** 2).sum(-1).argmin(1) for m, c in enumerate(self.centres)], 1)
        part = np.stack([((xs[:, m] - c[codes[:, m]]) * xs[:, m]).sum(1) for m, c in enumerate(self.centres)], 1)
        total = part.sum(1)
        for _ in range(sweeps):
            for m, c in enumerate(self.centres):
                r = xs[:, m, None] - c
                dot = (r * xs[:, m, None]).sum(-1)
                loss = self.across * (r**2).sum(-1) + (self.along - self.across) * ((total - part[:, m])[:, None] + dot) ** 2
                codes[:, m] = loss.argmin(1)
                new = np.take_along_axis(dot, codes[:, m, None], 1)[:, 0]
                total += new - part[:, m]
                part[:, m] = new
        return codes.astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each byte (two codes) and its 256 values, what a scan adds to the sum of every query."""
        t = np.einsum("qmd,mcd->mcq", _cut(q, len(self.centres)), self.centres).astype(np.float32)
        return (t[0::2, :, None] + t[1::2, None, :]).reshape(-1, 256, len(q))


def _cut(x: np.ndarray, m: int) -> np.ndarray:
    """Subspaces of two places; zeros fill the last."""
    return np.pad(x, ((0, 0), (0, 2 * m - x.shape[1]))).reshape(len(x), m, 2)


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte."""
    return codes[:, 0::2] << 4 | codes[:, 1::2]


def train(x: np.ndarray, threshold: float = 0.2, rounds: int = 8, seed: int = 3) -> Codebook:
    """Centres from unit vectors: codes and least-squares centres in turns."""
    d = x.shape[1]
    m = 2 * -(-d // 4)
    xs = _cut(x, m)
    rng = np.random.default_rng(seed)
    start = xs[rng.choice(len(x), 16, replace=len(x) < 16)].transpose(1, 0, 2).copy()
    along = (d - 1) * threshold**2 / (1 - threshold**2)
    book = Codebook(start, max(along, 1.0), 1.0)
    extra = book.along - book.across
    for _ in range(rounds):
        codes = book.encode(x, 1)
        part = np.stack([((xs[:, k] - c[codes[:, k]]) * xs[:, k]).sum(1) for k, c in enumerate(book.centres)], 1)
        total = part.sum(1)
        for k in range(m):
            v, code = xs[:, k], codes[:, k]
            rest = total - part[:, k] + (v**2).sum(1)
            add = lambda w: np.bincount(code, w, 16)  # noqa: E731, B023
            n = add(np.ones(len(v)))
            a = np.empty((16, 2, 2))
            for i in range(2):
                for j in range(2):
                    a[:, i, j] = book.across * n * (i == j) + extra * add(v[:, i] * v[:, j])
            b = np.stack([book.across * add(v[:, i]) + extra * add(rest * v[:, i]) for i in range(2)], 1)
            some = n > 0
            book.centres[k, some] = np.linalg.solve(a[some] + 1e-9 * np.eye(2), b[some][..., None])[..., 0]
            part[:, k] = ((v - book.centres[k][code]) * v).sum(1)
            total = part.sum(1)
    return book


def leaves_of(x: np.ndarray, n: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """n coarse centres of unit vectors, by spherical k-means."""
    c = x[np.random.default_rng(seed).choice(len(x), n, replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        for j in range(n):
            if (near == j).any():
                m = x[near == j].mean(0)
                c[j] = m / max(float(np.sqrt((m**2).sum())), 1e-12)
    return c


def fit(x: np.ndarray, n_rows: int, k: int, found: float = 0.985, most_leaves: int = 256) -> Codebook:
    """A codebook from unit vectors, with leaves for n_rows, and probes and margin as these vectors ask for."""
    book = train(x)
    n = max(1, min(most_leaves, len(x) // 64, n_rows // (2 * BLOCK)))
    book.leaves = leaves_of(x, n) if n > 1 else x[:1]
    asked = x[: min(400, len(x))]
    true = asked @ x.T
    true[np.arange(len(asked)), np.arange(len(asked))] = -2
    top = np.argsort(-true, 1)[:, : min(4 * k, max(1, len(x) - 1))]
    near = (x @ book.leaves.T).argmax(1)
    rank = np.argsort(np.argsort(-(asked @ book.leaves.T), 1), 1)
    held = np.sort(np.take_along_axis(rank, near[top[:, :k]], 1).ravel())
    book.probes = int(held[min(len(held) - 1, int(np.ceil(found * len(held))) - 1)]) + 1
    sums = scan(book.tables(asked), packed(book.encode(x)))
    book.margin = max(0.0, float(np.quantile(np.take_along_axis(true - sums, top, 1), 0.999))) + 1e-6
    return book


def scan(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sums of table entries for every query and row. A row takes a run of entries, one for each query, at once."""
    out = np.zeros((len(codes), tables.shape[2]), np.float32)
    for table, code in zip(tables, codes.T):
        out += table[code]
    return np.ascontiguousarray(out.T)


def _vectors(col: pa.Array, d: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that their largest place is near 1: cosines stay the same to the last bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _best(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best (query, vec_id, score) of each query, each vec_id once; ties to the smaller vec_id."""
    order = np.lexsort((-s, v, q))
    first = np.concatenate([[True], (q[order][1:] != q[order][:-1]) | (v[order][1:] != v[order][:-1])])
    order = order[first]
    order = order[np.lexsort((v[order], -s[order], q[order]))]
    begin = np.flatnonzero(np.concatenate([[True], q[order][1:] != q[order][:-1]]))
    place = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[place < k]


class _Asked:
    """A block of queries and the best rows seen for them so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.norm = np.sqrt((x**2).sum(1))
        self.q, self.v, self.s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def least(self) -> np.ndarray:
        """For each query the k-th best score, or -inf."""
        out = np.full(len(self.ids), -np.inf)
        n = np.bincount(self.q, minlength=len(self.ids))
        end = np.cumsum(n) - 1
        out[n >= self.k] = self.s[end[n >= self.k]]
        return out

    def take(self, q: np.ndarray, r: np.ndarray, ids: np.ndarray, x: np.ndarray, norm: np.ndarray) -> None:
        """Compare pairs of a query and a row exactly."""
        other = ids[r] != self.ids[q]
        q, r = q[other], r[other]
        for i in range(0, len(q), PAIRS):
            a, b = q[i : i + PAIRS], r[i : i + PAIRS]
            s = np.einsum("ij,ij->i", self.x[a], x[b]) / (self.norm[a] * norm[b])
            q2, v2, s2 = np.concatenate([self.q, a]), np.concatenate([self.v, ids[b]]), np.concatenate([self.s, s])
            keep = _best(q2, v2, s2, self.k)
            self.q, self.v, self.s = q2[keep], v2[keep], s2[keep]

    def meet(self, ids: np.ndarray, x: np.ndarray, sums: np.ndarray, margin: float) -> None:
        """Rows with their sums (queries x rows): the likeliest first, then all that may still be among the best."""
        norm = np.sqrt((x**2).sum(1))
        m = min(2 * self.k, len(ids))
        top = np.argpartition(-sums, m - 1, 1)[:, :m] if m < len(ids) else np.broadcast_to(np.arange(len(ids)), sums.shape)
        likely = np.take_along_axis(sums, top, 1) >= (self.least() - margin)[:, None]
        q, at = np.nonzero(likely)
        self.take(q, top[q, at], ids, x, norm)
        q, r = np.nonzero(sums >= (self.least() - margin)[:, None])
        self.take(q, r, ids, x, norm)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, max_fit: int = 10000) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, its k nearest others.

    Rows are coded and dealt to buckets of their leaves, so a leaf with a third of all rows has many; queries are packed
    in blocks by leaf, copied to each of its buckets and meet the rows there by an equi-join. Buckets grow with the
    table up to a bound, which keeps the copies few.
    """
    spark = ready(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.coalesce(sound, F.lit(False))).withColumn("d", F.size("v"))
    sizes = rows.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = sizes["d"]
    usual = rows.filter(F.col("d") == d)
    sample = lowest(usual, F.col("vec_id").cast("string"), max_fit, sizes["n"]).select("v").toArrow()
    book = fit(_unit(_vectors(sample["v"].combine_chunks(), d)), sizes["n"], k)
    shared = spark.sparkContext.broadcast(book)  # 16 * d numbers and at most 256 centres
    asks = rows.filter(F.expr(f"vec_id % {every} = 0")).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))

    def place(most: int):
        """(d, leaf, vec_id, v): a vector of the usual length with each of its `most` nearest leaves, others with -1."""

        def run(batches):
            for b in batches:
                usual = b["d"].to_numpy() == d
                own, far = b.filter(pa.array(usual)), b.filter(pa.array(~usual))
                if own.num_rows:
                    near = _unit(_vectors(own["v"], d)) @ shared.value.leaves.T
                    leaf = np.argsort(-near, 1, kind="stable")[:, :most] if most > 1 else near.argmax(1)[:, None]
                    own = own.take(pa.array(np.repeat(np.arange(own.num_rows), leaf.shape[1])))
                    yield pa.RecordBatch.from_arrays([own["d"], pa.array(leaf.ravel().astype(np.int32)), own["vec_id"], own["v"]], ["d", "leaf", "vec_id", "v"])
                if far.num_rows:
                    yield pa.RecordBatch.from_arrays([far["d"], pa.array(np.full(far.num_rows, -1, np.int32)), far["vec_id"], far["v"]], ["d", "leaf", "vec_id", "v"])

        return run

    schema = "d int, leaf int, vec_id long, v array<double>"
    placed = rows.select("d", "vec_id", "v").mapInArrow(place(1), schema)
    each = min(BUCKET, max(BLOCK, sizes["n"] // 256))
    # Rows of each leaf: at most 256, and one for each other length.
    counts = placed.groupBy("d", "leaf").agg(F.count("*").alias("n")).select(F.col("d").alias("_d"), F.col("leaf").alias("_l"), F.ceil(F.col("n") / each).alias("buckets"))
    counts = stored(counts)
    same = (F.col("d") == F.col("_d")) & (F.col("leaf") == F.col("_l"))
    dealt = placed.join(counts, same).withColumn("bucket", F.pmod(F.xxhash64("vec_id"), F.col("buckets"))).withColumn("block", F.pmod(F.hash("vec_id"), F.lit(-(-each // BLOCK)))).select("d", "leaf", "bucket", "block", "vec_id", "v")

    def pack_rows(group: pa.Table) -> pa.Table:
        n = group["d"][0].as_py()
        ids, x = group["vec_id"].to_numpy(), _vectors(group["v"].combine_chunks(), n)
        # Of equal vectors only the k + 1 smallest ids can be among the best of any query.
        order = np.lexsort((ids, *x.T[::-1]))
        new = np.concatenate([[True], (x[order][1:] != x[order][:-1]).any(1)])
        begin = np.flatnonzero(new)
        place = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
        keep = order[place <= k]
        ids, x = ids[keep], _scaled(x[keep])
        codes = packed(shared.value.encode(_unit(x))).tobytes() if n == d else b""
        return pa.table({"d": pa.array([n], pa.int32()), "leaf": pa.array([group["leaf"][0].as_py()], pa.int32()), "bucket": pa.array([group["bucket"][0].as_py()], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "xs": pa.array([x.tobytes()], pa.binary()), "codes": pa.array([codes], pa.binary())})

    blocks = dealt.groupBy("d", "leaf", "bucket", "block").applyInArrow(pack_rows, "d int, leaf int, bucket long, ids binary, xs binary, codes binary")

    def pack_queries(batches):
        kept: dict = {}
        out = lambda key, some: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.array([i for i, _ in some], np.int64).tobytes()], pa.binary()), pa.array([_scaled(np.array([x for _, x in some], float)).tobytes()], pa.binary())], ["qd", "ql", "q_ids", "qs"])
        n = 0
        for b in batches:
            for key, i, x in zip(zip(b["d"].to_pylist(), b["leaf"].to_pylist()), b["vec_id"].to_pylist(), b["v"].to_pylist()):
                own = kept.setdefault(key, [])
                own.append((i, x))
                n += 1
                if len(own) >= QUERIES:
                    yield out(key, kept.pop(key))
                    n -= len(own)
            if n >= 64 * QUERIES:
                yield from (out(key, some) for key, some in kept.items())
                kept, n = {}, 0
        yield from (out(key, some) for key, some in kept.items())

    # Queries of a leaf are brought together first, so that blocks are full.
    share = -(-sizes["n"] * book.probes // (every * len(book.leaves) * 8 * QUERIES))
    sent = asks.mapInArrow(place(book.probes), schema).repartition(parts(len(book.leaves) * share, 8), "d", "leaf", F.pmod(F.xxhash64("vec_id"), F.lit(share)))
    sent = sent.mapInArrow(pack_queries, "qd int, ql int, q_ids binary, qs binary")
    sent = sent.join(counts, (F.col("qd") == F.col("_d")) & (F.col("ql") == F.col("_l"))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)))

    def search(batches):
        kept: dict[bytes, _Asked] = {}

        def out():
            for a in kept.values():
                yield pa.RecordBatch.from_arrays([pa.array(a.ids[a.q]), pa.array(a.v), pa.array(a.s)], ["query_id", "vec_id", "score"])

        for b in batches:
            for n, ids, x, codes, q_ids, qs in zip(*[b[c].to_pylist() for c in ("d", "ids", "xs", "codes", "q_ids", "qs")]):
                ids, x = np.frombuffer(ids, np.int64), np.frombuffer(x).reshape(-1, n)
                a = kept.get(q_ids)
                if a is None:
                    if len(kept) >= KEPT:
                        yield from out()
                        kept = {}
                    a = kept[q_ids] = _Asked(np.frombuffer(q_ids, np.int64), np.frombuffer(qs).reshape(-1, n), k)
                unit = a.x / a.norm[:, None]
                if codes:
                    tables, codes = shared.value.tables(unit), np.frombuffer(codes, np.uint8).reshape(len(ids), -1)
                for i in range(0, len(ids), 2048):
                    some = slice(i, i + 2048)
                    sums, margin = (scan(tables, codes[some]), shared.value.margin) if len(codes) else (unit @ _unit(x[some]).T, 1e-9)
                    a.meet(ids[some], x[some], sums, margin)
        yield from out()

    met = blocks.join(sent.hint("shuffle_hash"), (F.col("d") == F.col("qd")) & (F.col("leaf") == F.col("ql")) & (F.col("bucket") == F.col("qb"))).select("d", "ids", "xs", "codes", "q_ids", "qs")
    found = met.mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
