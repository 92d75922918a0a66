import hashlib
import math
from collections import Counter, defaultdict

import pytest
from brute import words
from pyspark.sql import functions as F

from emberflow.llm import mixing, sharding


def test_sharding(docs, nothing):
    tree = sharding.Tree.even(2, 3, 4)
    rows = sharding.assign_shards(docs, tree, docs.count()).collect()
    assert len(rows) == docs.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r["doc_id"], r["shard"]) for r in rows}) == len({r["doc_id"] for r in rows})
    assert sharding.assign_shards(nothing, tree, 0).count() == 0


def test_weights_move_rows_only_into_the_subtree_that_grew(spark):
    keys = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    old = sharding.Tree((((1.0, 1.0), (1.0, 1.0)), ((1.0, 1.0), (1.0, 1.0))))
    new = sharding.Tree((((1.0, 1.0), (1.0, 1.0)), ((1.0, 1.0), (1.0, 3.0))))
    both = sharding.with_shard(sharding.with_shard(keys, "k", old, "a"), "k", new, "b")
    moves = Counter((r["a"], r["b"]) for r in both.collect())
    # Region 1 (shards 4-7) grew: what moves lands there; inside it what moves lands in rack 3, there in shard 7.
    for (a, b), _ in moves.items():
        assert a == b or (a < 4 and b >= 4) or (a in (4, 5) and b in (6, 7)) or (a == 6 and b == 7)
    share = sum(n for (_, b), n in moves.items() if b == 7) / 20000
    assert share == pytest.approx(3 / 10, abs=0.02)


def test_mixing(docs, nothing):
    a = sorted(map(tuple, mixing.mix(docs).fillna(-1).collect()), key=str)
    b = sorted(map(tuple, mixing.mix(docs.repartition(5)).fillna(-1).collect()), key=str)
    assert a == b
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    size, target, taken = Counter(), {}, Counter()
    for r in rows:
        assert r["size"] == len(words(texts[r["doc_id"]])) and r["taken"] <= 3 * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    for s in size:
        assert target[s] <= 3 * size[s] + 1e-6 and taken[s] == pytest.approx(target[s], rel=0.03, abs=12)
    assert mixing.mix(nothing).count() == 0


def test_targets_are_filled_up_to_the_cap(spark):
    per = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 100), (None, 890)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(per).collect()}
    # Weights 1, 2, 3, 1 by code point, null last; b stops at 30 and c at 300, the rest is shared 1 to 1.
    assert got == {"b": 30.0, "c": 300.0, "a": pytest.approx(835.0), None: pytest.approx(835.0)}
    none = {r["source"]: r["target"] for r in mixing.targets(per.withColumn("source_size", F.lit(0).cast("long"))).collect()}
    assert set(none.values()) == {0.0}


def test_mixed_documents_keep_columns_and_meet_targets(spark, docs, nothing):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and mixing.mixed_documents(nothing).count() == 0
    for r, n in Counter(out.collect()).items():
        assert n <= 3 * (3 if r["doc_id"] == 9 else 1)
    rows = [(i, " ".join(["w"] * (1 + i % 40)), f"s{i % 3}" if i % 9 else None, i) for i in range(6000)]
    big = spark.createDataFrame(rows, "doc_id long, text string, source string, _mix_id long")
    m = mixing.mix(big).collect()
    target, got = {r["source"]: r["target"] for r in m}, Counter()
    once = sorted(map(tuple, mixing.mixed_documents(big).collect()), key=str)
    assert once == sorted(map(tuple, mixing.mixed_documents(big.repartition(7)).collect()), key=str)
    for _, text, source, _ in once:
        got[source] += len(text.split())
    assert all(got[s] == pytest.approx(t, rel=0.06) for s, t in target.items())
    # Rows that share an id keep their own texts.
    twice = spark.createDataFrame([(1, "a b c", "s"), (1, "d", "s"), (1, "e f", "t"), (2, None, None)], "doc_id long, text string, source string")
    assert {r["text"] for r in mixing.mixed_documents(twice).collect()} <= {"a b c", "d", "e f", None}


def plain_schedule(docs, weights=(1, 2, 3), most=3):
    """Words taken of each row, slot by slot, for rows (doc_id, source, text) with distinct doc_ids."""
    size = {i: len(words(t)) for i, _, t in docs}
    source = {i: s for i, s, _ in docs}
    total = Counter()
    for i, n in size.items():
        total[source[i]] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    open_, left, target = set(order), sum(total.values()), {}
    while True:
        level = left / sum(w[s] for s in open_) if open_ else 0
        full = {s for s in open_ if most * total[s] <= w[s] * level}
        if not full:
            break
        for s in full:
            target[s] = most * total[s]
            left -= target[s]
        open_ -= full
    target.update({s: w[s] * level for s in open_})
    everything = sum(total.values())
    block = max(1, min(256, everything // 4096))
    blocks = {s: max(1, -(-total[s] // block)) for s in order}
    want = {s: target[s] * blocks[s] / total[s] if total[s] else 0.0 for s in order}
    units = {s: round(want[s] * 2**20) for s in order}
    at, cuts = 0, []
    for s in order:
        cuts.append((at / sum(units.values()), (at + units[s]) / sum(units.values()), s))
        at += units[s]
    rank, times = Counter(), Counter()
    for slot in range(round(sum(want.values()))):
        u = (slot + 0.5) * mixing.GOLDEN % 1.0
        s = next(s for lo, hi, s in cuts if lo <= u < hi)
        if rank[s] < most * blocks[s]:
            times[s, rank[s] % blocks[s]] += 1
        rank[s] += 1
    taken, place = {}, Counter()
    for i in sorted(size, key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
        s, taken[i] = source[i], 0
        for word in range(place[s], place[s] + size[i]):
            taken[i] += times[s, ((word + 1) * blocks[s] - 1) // total[s]]
        place[s] += size[i]
    return taken, target


def test_mixing_is_the_plain_schedule(spark):
    rows = [(i, [None, "a", "b", "c", "d"][min(4, i % 7)], " ".join(["w"] * (i * i % 53))) for i in range(400)]
    taken, target = plain_schedule(rows)
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["taken"] for r in got} == taken
    assert all(r["target"] == pytest.approx(target[r["source"]]) for r in got)


def plain_shard(key, regions, extra=None):
    """The shard by redrawing every level, and the one under an extra region of that weight."""

    def least(path, weights):
        def draw(i, w):
            bits = int(hashlib.md5(f"{key}|{'.'.join(map(str, [*path, i]))}".encode()).hexdigest()[:13], 16)
            return -math.log((bits + 0.5) / 2**52) / w

        return min(range(len(weights)), key=lambda i: draw(i, weights[i]))

    def descend(regions):
        r = least([], [sum(map(sum, racks)) for racks in regions])
        k = least([r], [sum(rack) for rack in regions[r]])
        s = least([r, k], regions[r][k])
        return sum(len(rack) for racks in regions[:r] for rack in racks) + sum(len(rack) for rack in regions[r][:k]) + s

    return descend(regions), descend((*regions, ((extra,),)))


def test_shards_are_those_of_plain_draws(spark):
    tree = sharding.Tree((((1.0, 2.0), (0.5,)), ((3.0, 1.0, 1.0), (1.0, 1.0)), ((2.0,),)))
    keys = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    for r in sharding.with_shard(keys, "k", tree, "a", "b", 1.5).collect():
        assert (r["a"], r["b"]) == plain_shard(r["k"], tree.regions, 1.5)


def test_slots_are_spread(spark, docs):
    p = mixing.plan(mixing.sizes(docs))
    slots = sorted((r["slot"], str(r["source"])) for r in p["slots"].collect())
    n = Counter(s for _, s in slots)
    half = Counter(s for i, s in slots[: len(slots) // 2])
    assert all(abs(half[s] - n[s] / 2) <= 6 for s in n)
