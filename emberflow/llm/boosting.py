"""Gradient-boosted trees of logistic loss over binned features, in numpy, and over rows that Spark holds.

A level of a tree is split by sums of gradients, curvatures and rows by node, feature and bin. Rows that fall into the same
bins are one cell with a weight, so blocks of cells give these sums, and whoever holds the blocks adds them up: `boost` has
one block, `boosted_over` a frame of any number, of which only the chosen splits come to the driver. Several trees (of
folds, or of kinds of rows) grow level by level together. Sums are of whole multiples of UNIT, so that they, and the trees,
don't depend on how cells are dealt to blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emberflow.llm.common import stored

ROUNDS, DEPTH, RATE, BINS, RIDGE, LEAST = 60, 4, 0.2, 32, 1.0, 5
UNIT = 2.0**-20
#: Rounds after which the blocks of a frame are written again with their margins.
KEEP = 10

Nodes = list[tuple[int, int, int, int, float]]
#: A feature (-1: none), its last bin to the left, gradient and curvature of all rows and of those to the left.
Split = tuple[int, int, float, float, float, float]


def leaves(nodes: Nodes, b: np.ndarray) -> np.ndarray:
    """The leaf that each row ends in."""
    feature, cut, left, right = (np.array([n[i] for n in nodes]) for i in range(4))
    at = np.zeros(len(b), np.int64)
    rows = np.flatnonzero(feature[at] >= 0)
    while len(rows):
        k = at[rows]
        at[rows] = np.where(b[rows, feature[k]] <= cut[k], left[k], right[k])
        rows = rows[feature[at[rows]] >= 0]
    return at


def values(nodes: Nodes, b: np.ndarray) -> np.ndarray:
    return np.array([n[4] for n in nodes])[leaves(nodes, b)]


@dataclass
class Boosted:
    """Trees as lists of nodes (feature, bin, left, right, value); feature -1 marks a leaf."""

    cuts: list[np.ndarray]
    base: float
    rate: float
    trees: list[Nodes] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1).astype(np.int16)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.margin_binned(self.binned(x)) if len(x) else np.zeros(0)

    def margin_binned(self, b: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((values(t, b) for t in self.trees), np.zeros(len(b)))

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


@dataclass
class Block:
    """Cells: bins, whether true, rows and weight by model, and margins after the first `done` trees of each model."""

    b: np.ndarray
    y: np.ndarray
    n: np.ndarray
    w: np.ndarray
    z: np.ndarray
    done: int = 0

    def follow(self, trees: list[list[Nodes]]) -> None:
        """Add trees that the margins don't have yet."""
        for t, some in enumerate(trees):
            for nodes in some[self.done :]:
                self.z[:, t] += RATE * values(nodes, self.b)
        self.done = max(map(len, trees), default=0)

    def sums(self, t: int, nodes: Nodes, opened: list[int]) -> np.ndarray:
        """By open node of model t's newest tree: gradients, curvatures (in UNITs) and rows by feature and bin."""
        slot = np.full(len(nodes), -1)
        slot[opened] = np.arange(len(opened))
        slot = slot[leaves(nodes, self.b)]
        rows = np.flatnonzero((slot >= 0) & (self.n[:, t] > 0))
        p, w, m = 1 / (1 + np.exp(-self.z[rows, t])), self.w[rows, t], self.b.shape[1]
        g, h = np.rint(w * (self.y[rows] - p) / UNIT), np.rint(w * np.maximum(p * (1 - p), 1e-9) / UNIT)
        place = ((slot[rows, None] * m + np.arange(m)) * BINS + self.b[rows]).ravel()
        return np.stack([np.bincount(place, np.repeat(v, m), len(opened) * m * BINS).reshape(len(opened), m, BINS) for v in (g, h, self.n[rows, t])], 1)


def best_split(sums: np.ndarray) -> Split:
    """Where the gain in loss is largest."""
    g, h, n = sums * np.array([UNIT, UNIT, 1.0])[:, None, None]
    gs, hs, ns = g[0].sum(), h[0].sum(), n[0].sum()
    cg, ch, cn = (np.cumsum(v, 1)[:, :-1] for v in (g, h, n))
    gain = cg**2 / (ch + RIDGE) + (gs - cg) ** 2 / (hs - ch + RIDGE) - gs**2 / (hs + RIDGE)
    gain[(cn < LEAST) | (ns - cn < LEAST)] = 0
    f, i = divmod(int(gain.argmax()), gain.shape[1])
    return (f, i, float(gs), float(hs), float(cg[f, i]), float(ch[f, i])) if gain[f, i] > 1e-6 else (-1, 0, float(gs), float(hs), 0.0, 0.0)


def grow(n_models: int, split: Callable[[list[list[Nodes]], list[Nodes], list[list[int]]], dict[tuple[int, int], Split]]) -> list[list[Nodes]]:
    """Trees of each model, level by level; `split` gives the best split of every open node, by model and node."""
    trees: list[list[Nodes]] = [[] for _ in range(n_models)]
    value = lambda g, h: g / (h + RIDGE)
    for _ in range(ROUNDS):
        new: list[Nodes] = [[(-1, 0, 0, 0, 0.0)] for _ in trees]
        opened = [[0] for _ in trees]
        for _ in range(DEPTH):
            found = split(trees, new, opened) if any(opened) else {}
            opened = [[] for _ in trees]
            for (t, k), (f, cut, gs, hs, gl, hl) in sorted(found.items()):
                if f < 0:
                    new[t][k] = (-1, 0, 0, 0, value(gs, hs))
                    continue
                opened[t] += [len(new[t]), len(new[t]) + 1]
                new[t][k] = (f, cut, *opened[t][-2:], 0.0)
                new[t] += [(-1, 0, 0, 0, value(gl, hl)), (-1, 0, 0, 0, value(gs - gl, hs - hl))]
        for some, nodes in zip(trees, new):
            some.append(nodes)
    return trees


def grown(block: Block) -> list[list[Nodes]]:
    """Trees of all models of one block."""

    def split(trees, new, opened):
        block.follow(trees)
        return {(t, k): best_split(s) for t, some in enumerate(opened) if some for k, s in zip(some, block.sums(t, new[t], some))}

    return grow(block.n.shape[1], split)


BLOCKS = "first int, models int, b binary, y binary, n binary, w binary, z binary"


def block_row(block: Block, first: int) -> dict:
    """A row of BLOCKS; its models are number `first` and those after it."""
    return {"first": first, "models": block.n.shape[1], "b": block.b.tobytes(), "y": block.y.tobytes(), "n": block.n.tobytes(), "w": block.w.tobytes(), "z": block.z.tobytes()}


def block_of(row: dict, done: int) -> Block:
    y = np.frombuffer(row["y"])
    n, w, z = (np.frombuffer(row[c]).reshape(len(y), row["models"]) for c in ("n", "w", "z"))
    return Block(np.frombuffer(row["b"], np.uint8).reshape(len(y), -1), y, n, w, z.copy(), done)


def boosted_over(blocks: DataFrame, n_models: int) -> list[list[Nodes]]:
    """Trees of all models over a frame of BLOCKS, one job a level: sums are added up by node in Spark."""
    spark = blocks.sparkSession
    done, schema = 0, pa.schema([("first", pa.int32()), ("models", pa.int32()), *[(c, pa.binary()) for c in "bynwz"]])

    def split(trees, new, opened):
        nonlocal blocks, done
        if len(trees[0]) >= done + KEEP:
            told, kept = spark.sparkContext.broadcast([t[done:] for t in trees]), done

            def follow(batches):
                for b in batches:
                    for row in b.to_pylist():
                        block = block_of(row, 0)
                        block.follow(told.value[row["first"] : row["first"] + row["models"]])
                        yield pa.RecordBatch.from_pylist([block_row(block, row["first"])], schema)

            blocks, done = stored(blocks.mapInArrow(follow, BLOCKS)), kept + KEEP
        shared = spark.sparkContext.broadcast(([t[done:] for t in trees], new, opened))  # a bounded number of nodes

        def add(batches):
            trees, new, opened = shared.value
            for b in batches:
                for row in b.to_pylist():
                    block, first = block_of(row, 0), row["first"]
                    block.follow(trees[first : first + row["models"]])
                    for t in range(row["models"]):
                        if some := opened[first + t]:
                            sums = block.sums(t, new[first + t], some)
                            yield pa.RecordBatch.from_pydict({"t": pa.array([first + t] * len(some), pa.int32()), "k": pa.array(some, pa.int32()), "s": pa.array([s.tobytes() for s in sums], pa.binary())})

        def settle(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
            best = best_split(sum(np.frombuffer(s) for s in rows["s"].to_pylist()).reshape(3, -1, BINS))
            return pa.table({c: pa.array([v], kind) for c, v, kind in zip(("t", "k", "f", "cut", "gs", "hs", "gl", "hl"), (*(x.as_py() for x in key), *best), [pa.int32()] * 4 + [pa.float64()] * 4)})

        found = blocks.mapInArrow(add, "t int, k int, s binary").groupBy("t", "k").applyInArrow(settle, "t int, k int, f int, cut int, gs double, hs double, gl double, hl double")
        return {(r["t"], r["k"]): tuple(r)[2:] for r in found.collect()}  # at most 8 rows a model

    return grow(n_models, split)


def cuts_of(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Where a feature's bins begin, from its distinct values in order and their weights: each value, or quantiles."""
    if len(value) <= BINS:
        return value[1:]
    total = np.cumsum(weight)
    return np.unique(value[np.minimum(np.searchsorted(total, np.linspace(0, 1, BINS + 1)[1:-1] * total[-1], "right"), len(value) - 1)])


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
    """Second-order boosting: each tree splits greedily where the gain in loss is largest. A row counts `weight` times in the loss."""
    weight = np.ones(len(y)) if weight is None else weight
    cuts = [cuts_of(*np.unique(c, return_counts=True)) for c in x.T]
    share = np.clip(np.average(y, weights=weight), 1e-6, 1 - 1e-6)
    model = Boosted(cuts, float(np.log(share / (1 - share))), RATE)
    model.trees = grown(Block(model.binned(x), y, np.ones((len(y), 1)), weight[:, None], np.full((len(y), 1), model.base)))[0]
    return model
