"""Similarity join of documents on 5-word shingles by a token-group matrix.

1. Shingle sets are hashed in tasks; equal sets are one node from then on, whatever rows hold them.
2. Sifting: a set that is similar to another one by t shares at least t of its tokens with others. Blocks of sets send
   each distinct token once (hashed shorter) to token shards; a shard answers each block with the number of tokens of
   each set that another set holds too. Tokens of one set that fall on one short value are each counted, so shorter
   hashes can only make more tokens look shared. Sets below t are done.
3. The texts of the rest are read once more. Shards answer their blocks with the frequency of every token, to the power
   of two, so each set puts its tokens in one common order, the rare ones first, and its prefix is known: by the prefix
   rule two sets of similarity t share one of their first |x| - ceil(t |x|) + 1 tokens.
4. Near copies find each other first: sets with the same least token (under two hashes) meet in groups of bounded size,
   and what is linked there is a cluster. Clusters of any size need no further comparison within.
5. Prefix tokens meet in shards. A block ties the holders of a token by size and sends only the ends of such runs, so a
   token that a third of all rows hold is a few entries a block. Tokens whose holders are in one cluster are left out;
   the others' ties make partitions. A large partition is cut: large clusters into chunks of their own, small ones into
   common chunks, and two chunks meet in a task unless both are of one cluster. So a cluster of a million near copies
   costs as many sets as it has members for each chunk of others that it is tied to.
6. In a task, similar documents form groups and the matrix holds each group's token union. A document's overlap with a
   union bounds its overlap with every member; only groups that reach the threshold are opened, and there only
   documents that aren't connected yet are compared, exactly.

Cases: without words or text a set is empty and links with nothing; 1 to 4 words are one shingle; rows with the same
doc_id are one document in the graph, linked by any of their texts, with a row each in the result; a null doc_id takes
no part and its component is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberflow.llm import arrays
from emberflow.llm.arrays import press, unpress
from emberflow.llm.common import parts, ready, small, stored, text_of
from emberflow.llm.graph import components, forest

#: Tokens in a block of documents; tokens in a shard; sets and tokens in a chunk of a partition; sets in a group.
BLOCK, SHARD, CHUNK, CHUNK_TOKENS, GROUP = 700_000, 1_000_000, 1000, 1_000_000, 16
#: Hashes under which near copies meet by their least token.
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_U = np.uint64


def least_overlap(n: int, percent: float) -> int:
    """Tokens that a set of n must share with any set similar to it by percent or more."""
    return int(np.ceil(percent * n / 100 - 1e-9))


def _blocks(batches, key: str = "doc_id", most: int = BLOCK):
    """Lists of (key, set) with about `most` tokens each, from texts or from sets made before."""
    ids, sets, n = [], [], 0
    for b in small(batches):
        own = b[key].to_pylist()
        if "tokens" in b.schema.names:
            made = [(0, [np.frombuffer(x, _U) for x in b["tokens"].to_pylist()])]
        else:
            made = ((at, arrays.shingle_sets(part)) for at, part in arrays.pieces(b["text"]))
        for at, some in made:
            sets += some
            ids += own[at : at + len(some)]
            n += sum(map(len, some))
            if n >= most:
                yield ids, sets
                ids, sets, n = [], [], 0
    if ids:
        yield ids, sets


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b""


def _cuts(tokens: np.ndarray, shift: int):
    """(shard, from, to) of the shards that rising tokens fall into by their leading bits; never more than tokens."""
    if not len(tokens):
        return []
    shard = tokens >> _U(shift) if shift < 64 else np.zeros(len(tokens), _U)
    begin = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    return zip(shard[begin].astype(np.int64).tolist(), begin.tolist(), [*begin[1:].tolist(), len(tokens)])


def _shards(n_tokens: int) -> int:
    """A power of two that gives a shard about SHARD tokens."""
    return 1 << (parts(max(1, n_tokens), SHARD) - 1).bit_length()


_ASKED = "shard long, block long, doc_id long, n long, digest binary, place int, t binary, c binary, w binary, m binary"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
_NAMES = [x.split()[0] for x in _ASKED.split(", ")]


def _asked(cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], _NAMES)


def sift(rows: DataFrame, n_tokens: int, percent: float) -> DataFrame:
    """For rows of doc_id and text: doc_id, n, digest and stays of each; n_tokens is about the number of words.

    A block sends one entry for each distinct token of its distinct sets, so a token or a text that makes up a third
    of all rows weighs no more than any other.
    """
    shards = _shards(n_tokens)
    bits = min(62, 4 + max(1, n_tokens).bit_length())
    shift, lead = 64 - bits, bits - (shards.bit_length() - 1)

    def ask(batches):
        block = TaskContext.get().partitionId() << 32
        for ids, sets in _blocks(batches):
            digests = [_digest(s) for s in sets]
            one: dict[bytes, int] = {}
            place = [one.setdefault(d, len(one)) for d in digests]
            first = {p: i for i, p in reversed(list(enumerate(place)))}
            own, many = zip(*[np.unique(sets[first[p]] >> _U(shift), return_counts=True) for p in range(len(one))])
            sizes = [len(s) for s in sets]
            del sets
            who, many = np.repeat(np.arange(len(own), dtype=np.uint32), [len(x) for x in own]), np.concatenate([x.astype(np.uint32) for x in many])
            t, own = np.concatenate(own), len(own)
            order = np.argsort(t, kind="stable")
            t, who, many = t[order], who[order], many[order]
            begin = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, int)
            count = np.diff(np.append(begin, len(t))).astype(np.uint32)
            # Tokens that several sets of this block hold are counted here; of the others the shard tells.
            here = np.bincount(who, many * np.repeat(count > 1, count), own).astype(np.int64)
            t, w, m = t[begin], who[begin], many[begin]
            # A block's own rows make a group of their own, below all shards.
            via = -1 - block
            for i in range(0, len(ids), 2048):
                k = len(ids[i : i + 2048])
                none = [None] * k
                yield _asked([[via] * k, [block] * k, ids[i : i + k], sizes[i : i + k], digests[i : i + k], place[i : i + k], none, none, none, none])
            for k, a, b in _cuts(t, lead):
                yield _asked([[k], [block], [None], [own], [None], [None], [press(np.diff(t[a:b], prepend=_U(0)))], *[[press(x[a:b])] for x in (count, w, m)]])
            yield _asked([[via], [block], [None], [None], [None], [-2], [None], [press(here)], [None], [None]])
            block += 1

    def count(group: pa.Table) -> pa.Table:
        asked = group.filter(pc.is_valid(group["t"]))
        ts = [np.cumsum(unpress(x, np.uint64), dtype=np.uint64) for x in asked["t"].to_pylist()]
        cs = [unpress(x, np.uint32).astype(np.int64) for x in asked["c"].to_pylist()]
        t, at = np.unique(np.concatenate([*ts, np.zeros(0, _U)]), return_inverse=True)
        total = np.bincount(at, np.concatenate([*cs, np.zeros(0)]), len(t)).astype(np.int64)
        out, x = [group.filter(pc.is_null(group["t"]))], 0
        for block, n, c, w, m in zip(asked["block"].to_pylist(), asked["n"].to_pylist(), cs, asked["w"].to_pylist(), asked["m"].to_pylist()):
            shared = (total[at[x : x + len(c)]] > 1) & (c == 1)
            x += len(c)
            out.append(pa.Table.from_batches([_asked([[0], [block], [None], [None], [None], [-2], [None], [press(np.bincount(unpress(w, np.uint32), shared * unpress(m, np.uint32), n).astype(np.int64))], [None], [None]])]))
        return pa.concat_tables(out)

    told = rows.mapInArrow(ask, _ASKED).groupBy("shard").applyInArrow(count, _ASKED)

    def judge(group: pa.Table) -> pa.Table:
        rows, answers = (group.filter(f(group["place"], 0)) for f in (pc.greater_equal, pc.less))
        shared = sum((unpress(x, np.int64) for x in answers["c"].to_pylist()), np.int64(0))
        n = rows["n"].to_numpy()
        stays = (np.asarray(shared)[rows["place"].to_numpy()] * 100 >= percent * n) & (n > 0)
        return rows.select(["doc_id", "n", "digest"]).append_column("stays", pa.array(stays))

    return told.select("block", "doc_id", "n", "digest", "place", "c").groupBy("block").applyInArrow(judge, "doc_id long, n long, digest binary, stays boolean")


def load_sets(texts: DataFrame) -> DataFrame:
    """block, nodes, sizes, tokens: sets of rows (node, digest, text), packed; a row whose text has another set than
    the digest tells is left out, and so are a task's repeats of a node."""

    def load(batches):
        block, seen = TaskContext.get().partitionId() << 32, set()

        def own():
            for b in small(batches):
                sets = arrays.shingle_sets(b["text"])
                keep = []
                for i, (node, s, d) in enumerate(zip(b["node"].to_pylist(), sets, b["digest"].to_pylist())):
                    if node not in seen and _digest(s) == d:
                        seen.add(node)
                        keep.append(i)
                yield pa.RecordBatch.from_arrays([b["node"].take(pa.array(keep, pa.int64())), pa.array([sets[i].tobytes() for i in keep], pa.binary())], ["node", "tokens"])

        for nodes, sets in _blocks(own(), "node"):
            sizes = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.array(nodes, np.int64).tobytes()], pa.binary()), pa.array([sizes.tobytes()], pa.binary()), pa.array([np.concatenate(sets).tobytes()], pa.binary())], ["block", "nodes", "sizes", "tokens"])
            block += 1

    return texts.select("node", "digest", "text").mapInArrow(load, "block long, nodes binary, sizes binary, tokens binary")


def prefixes(blocks: DataFrame, n_tokens: int, percent: float) -> DataFrame:
    """node, n, tokens, prefix, least: of the sets of blocks that share enough tokens with others, in all n, the sorted
    tokens, those of the prefix that others hold too, and the least token under each of SEEDS."""
    shift = 64 - (_shards(n_tokens).bit_length() - 1)
    schema = "shard long, block long, t binary, c binary"
    one = lambda k, block, t, c: pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([block], pa.int64()), pa.array([t], pa.binary()), pa.array([c], pa.binary())], ["shard", "block", "t", "c"])

    def ask(batches):
        for b in batches:
            for block, tokens in zip(b["block"].to_pylist(), b["tokens"].to_pylist()):
                t, count = np.unique(np.frombuffer(tokens, _U), return_counts=True)
                for k, x, y in _cuts(t, shift):
                    yield one(k, block, t[x:y].tobytes(), press(count[x:y].astype(np.uint32)))

    def count(group: pa.Table) -> pa.Table:
        ts = [np.frombuffer(x, _U) for x in group["t"].to_pylist()]
        t, at = np.unique(np.concatenate(ts), return_inverse=True)
        total = np.bincount(at, np.concatenate([unpress(x, np.uint32) for x in group["c"].to_pylist()]), len(t))
        level, out, x = np.ceil(np.log2(total)).astype(np.uint8), [], 0
        for k, block, own in zip(group["shard"].to_pylist(), group["block"].to_pylist(), ts):
            out.append(one(k, block, None, press(level[at[x : x + len(own)]])))
            x += len(own)
        return pa.Table.from_batches(out)

    answers = blocks.mapInArrow(ask, schema).groupBy("shard").applyInArrow(count, schema).select(F.col("block").alias("of"), "shard", "c")

    def order(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for nodes, sizes, tokens in zip(left["nodes"].to_pylist(), left["sizes"].to_pylist(), left["tokens"].to_pylist()):
            nodes, sizes, tokens = np.frombuffer(nodes, np.int64), np.frombuffer(sizes, np.int64), np.frombuffer(tokens, _U)
            t, at = np.unique(tokens, return_inverse=True)
            told = dict(zip(right["shard"].to_pylist(), right["c"].to_pylist()))
            level = np.concatenate([unpress(told[k], np.uint8) for k, _, _ in _cuts(t, shift)])[at]
            end = 0
            for node, n in zip(nodes.tolist(), sizes.tolist()):
                s, r = tokens[end : end + n], level[end : end + n]
                end += n
                if 100 * int((r > 0).sum()) < percent * n:
                    continue
                first = np.argsort(r, kind="stable")[: n - least_overlap(n, percent) + 1]
                out.append((node, n, s.tobytes(), s[first][r[first] > 0].tobytes(), [int(arrays.mix(s ^ _U(x)).min().view(np.int64)) for x in SEEDS]))
        cols = list(zip(*out)) if out else [[]] * 5
        return pa.table([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())])], ["node", "n", "tokens", "prefix", "least"])

    return blocks.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(order, "node long, n long, tokens binary, prefix binary, least array<long>")


def matrix_pairs(ids: np.ndarray, sets: list[np.ndarray], percent: float, clusters: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links among these distinct sets that connect all that links connect: two ids and their similarity. Sets of one
    of `clusters`, where given, count as connected."""
    m = len(sets)
    order = sorted(range(m), key=lambda i: (int(sets[i][0]), len(sets[i]), int(ids[i])))
    sets, ids = [sets[i] for i in order], np.asarray(ids)[order]
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    group = np.arange(m) // GROUP
    n_groups = int(group[-1]) + 1
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.repeat(group, sizes)
    # The matrix by token: the groups whose union holds it.
    cell = np.unique(token.astype(np.int64) * n_groups + own)
    column = cell % n_groups
    begins = np.searchsorted(cell, np.arange(int(token.max()) + 2, dtype=np.int64) * n_groups)
    members = np.split(np.arange(m), np.arange(GROUP, m, GROUP))
    smallest = np.array([sizes[g].min() for g in members])
    root = list(range(m))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if clusters is not None:
        lead: dict = {}
        root = [lead.setdefault(clusters[k], i) for i, k in enumerate(order)]
    found: list[tuple[int, int, float]] = []
    here = np.zeros(int(token.max()) + 1, bool)
    for i in range(m):
        mine = token[ends[i] - sizes[i] : ends[i]]
        lens = begins[mine + 1] - begins[mine]
        at = np.repeat(begins[mine], lens) + arrays._ramp(lens)
        bound = np.bincount(column[at], minlength=n_groups)
        need = np.maximum(sizes[i], smallest)
        open_ = np.flatnonzero(bound * 100 >= percent * need)
        open_ = open_[open_ >= group[i]]
        if not len(open_):
            continue
        here[mine] = True
        for g in open_:
            for j in members[g]:
                a, b = sizes[i], sizes[j]
                if j <= i or min(a, b) * 100 < percent * max(a, b) or find(i) == find(j):
                    continue
                both = int(here[token[ends[j] - b : ends[j]]].sum())
                if 100 * both >= percent * (a + b - both):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
                    found.append((ids[i], ids[j], both / (a + b - both)))
        here[mine] = False
    u, v, like = zip(*found) if found else ((), (), ())
    return np.array(u, np.int64), np.array(v, np.int64), np.array(like, float)


def _link(group: pa.Table, percent: float) -> pa.Table:
    """Links of a group of rows (node, tokens, and cluster where there is one), each node once."""
    seen = {n: i for i, n in reversed(list(enumerate(group["node"].to_pylist())))}
    rows = group.take(pa.array(sorted(seen.values()), pa.int64()))
    clusters = rows["cluster"].to_pylist() if "cluster" in rows.column_names else None
    u, v, like = matrix_pairs(np.array(rows["node"].to_pylist(), np.int64), [np.frombuffer(x, _U) for x in rows["tokens"].to_pylist()], percent, clusters)
    return pa.table({"u": u, "v": v, "jaccard": like})


LINKS = "u long, v long, jaccard double"


def near_copies(sets: DataFrame, percent: float) -> DataFrame:
    """u, v, jaccard: links among sets (node, n, tokens, least) that share a least token, in groups of bounded size."""
    keys = sets.select("node", "n", F.posexplode("least").alias("r", "key"))
    sizes = keys.groupBy("r", "key").agg(F.count("*").alias("m"), F.sum("n").alias("total")).filter("m > 1")
    sizes = sizes.withColumn("chunks", F.greatest(F.ceil(F.col("m") / CHUNK), F.ceil(F.col("total") / CHUNK_TOKENS)))
    dealt = keys.join(sizes, ["r", "key"]).select("node", "r", "key", F.pmod(F.xxhash64("node", "r"), F.col("chunks")).alias("chunk"))
    rows = sets.select("node", "tokens").join(dealt, "node")
    return rows.groupBy("r", "key", "chunk").applyInArrow(lambda g: _link(g, percent), LINKS)


def ties_of(prefix: DataFrame, n_tokens: int, percent: float) -> DataFrame:
    """u, v: rows (node, n, cluster, tokens: those of the prefix) tied so that every two of different clusters which
    hold a common token, at sizes that can match, are connected. Ties within a cluster are made on the way."""
    shift = 64 - (_shards(n_tokens).bit_length() - 1)
    schema = "shard long, t binary, low binary, high binary, node binary, cluster binary, u binary, v binary"
    kinds = [pa.int64(), *[pa.binary()] * 7]
    names = [x.split()[0] for x in schema.split(", ")]

    def runs(t, low, high, node, cluster):
        """Runs of compatible holders of one token: from rows in order of token and low, (first row, last row) of each,
        the largest high, the ties between neighbours, and the cluster or -1 if there are several."""
        top = high.copy()
        begin = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(t)]):
            if b - a > 1:
                top[a:b] = np.maximum.accumulate(high[a:b])
        joined = np.concatenate([[False], (t[1:] == t[:-1]) & (top[:-1] * 100 >= percent * low[1:])])
        start = np.flatnonzero(~joined)
        run = np.cumsum(~joined) - 1
        mixed = np.bincount(run, np.concatenate([[False], joined[1:] & (cluster[1:] != cluster[:-1])]) | (cluster < 0), len(start)) > 0
        end = np.append(start[1:], len(t)) - 1
        return start, end, top, joined, run, np.where(mixed, -1, cluster[start])

    def post(batches):
        for keys, sets in _blocks(_tupled(batches), "key"):
            keys = np.array(keys, np.int64).reshape(-1, 3)
            t, w = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            if not len(t):
                continue
            order = np.lexsort((keys[w, 0], keys[w, 1], t))
            t, w = t[order], w[order]
            node, n, cluster = keys[w].T
            start, end, top, joined, _, own = runs(t, n, n, node, cluster)
            u, v = forest(node[1:][joined[1:]], node[:-1][joined[1:]])
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([[-1], [None], [None], [None], [None], [None], [press(u)], [press(v)]], kinds)], names)
            t, cols = t[start], [n[start], top[end], node[start], own]
            for k, a, b in _cuts(t, shift):
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip([[k], [t[a:b].tobytes()], *[[press(c[a:b].astype(np.int64))] for c in cols], [None], [None]], kinds)], names)

    def meet(group: pa.Table) -> pa.Table:
        t = np.concatenate([np.frombuffer(x, _U) for x in group["t"].to_pylist()])
        low, high, node, cluster = (np.concatenate([unpress(x, np.int64) for x in group[c].to_pylist()]) for c in ("low", "high", "node", "cluster"))
        order = np.lexsort((node, low, t))
        t, low, high, node, cluster = t[order], low[order], high[order], node[order], cluster[order]
        _, _, _, joined, run, own = runs(t, low, high, node, cluster)
        tied = joined & (own[run] < 0)
        u, v = forest(node[tied], node[np.flatnonzero(tied) - 1])
        return pa.table({"u": u, "v": v})

    def local(batches):
        for b in batches:
            for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(unpress(u, np.int64)), pa.array(unpress(v, np.int64))], ["u", "v"])

    posts = stored(prefix.select("node", "n", "cluster", "tokens").mapInArrow(post, schema))
    far = posts.filter("shard >= 0").select(*names[:6]).groupBy("shard").applyInArrow(meet, "u long, v long")
    return far.unionByName(posts.filter("shard < 0").select("u", "v").mapInArrow(local, "u long, v long"))


def _tupled(batches):
    """Batches whose key is (node, n, cluster)."""
    for b in batches:
        keys = np.stack([b[c].to_numpy() for c in ("node", "n", "cluster")], 1) if b.num_rows else np.zeros((0, 3), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(keys), pa.list_(pa.int64())), b["tokens"]], ["key", "tokens"])


def compare(sets: DataFrame, ties: DataFrame, percent: float) -> DataFrame:
    """u, v, jaccard: links between clusters among sets (node, n, cluster, tokens) that ties (u, v) connect.

    A partition of the ties is cut into chunks: a cluster of more than CHUNK / 2 sets into chunks of its own, others by
    hash. Two chunks are a group unless both are of one cluster.
    """
    near = components(ties)
    # Every tied set is in `near`, but for the smallest of its partition.
    own = near.unionByName(near.select(F.col("root").alias("v"), "root").distinct())
    members = own.withColumnRenamed("root", "part").join(sets.select(F.col("node").alias("v"), "n", "cluster"), "v")
    several = members.groupBy("part").agg(F.min("cluster").alias("a"), F.max("cluster").alias("b")).filter("a <> b").select("part")
    members = stored(members.join(several, "part", "left_semi"))
    counted = members.groupBy("part", "cluster").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    big = (F.col("m") > CHUNK // 2) | (F.col("total") > CHUNK_TOKENS // 2)
    counted = counted.withColumn("own", F.when(big, F.col("cluster")).otherwise(-1))
    chunks = counted.groupBy("part", "own").agg(F.greatest(F.ceil(F.sum("m") / CHUNK), F.ceil(F.sum("total") / CHUNK_TOKENS)).alias("chunks"))
    placed = members.join(counted.select("part", "cluster", "own"), ["part", "cluster"]).join(chunks, ["part", "own"])
    placed = placed.select(F.col("v").alias("node"), "part", "cluster", "own", F.pmod(F.xxhash64("v"), F.col("chunks")).alias("chunk"))
    each = chunks.select("part", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")).select("part", F.struct("own", "chunk").alias("i"))
    whole = chunks.groupBy("part").agg(F.sum("chunks").alias("k"))
    # A chunk that meets others is whole in each such group; only one that is alone needs a group of its own.
    both = each.join(whole, "part").join(each.withColumnRenamed("i", "j"), "part").filter("i < j and (i.own <> j.own or i.own = -1) or i = j and k = 1")
    to = both.select("part", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("e")).select("part", "i", "j", F.col("e.own").alias("own"), F.col("e.chunk").alias("chunk"))
    rows = placed.join(to, ["part", "own", "chunk"]).select("node", "cluster", "part", "i", "j").join(sets.select("node", "tokens"), "node")
    return rows.groupBy("part", "i", "j").applyInArrow(lambda g: _link(g, percent), LINKS)


def links_of(texts: DataFrame, n_tokens: int, percent: float) -> DataFrame:
    """u, v, jaccard: verified links that connect all that links connect, among texts (node, digest, text)."""
    blocks = stored(load_sets(texts))
    sets = stored(prefixes(blocks, n_tokens, percent))
    if sets.select("node").distinct().count() < sets.count():
        sets = stored(sets.dropDuplicates(["node"]))  # a document was loaded by several tasks, from rows repeated with its id
    first = stored(near_copies(sets, percent))
    clusters = components(first.select("u", "v"))
    held = sets.join(clusters, sets["node"] == clusters["v"], "left").select("node", "n", F.coalesce("root", "node").alias("cluster"), "tokens", "prefix")
    held = stored(held)
    n_prefix = held.agg(F.sum(F.length("prefix"))).first()[0] or 0
    ties = ties_of(held.select("node", "n", "cluster", F.col("prefix").alias("tokens")), n_prefix // 8, percent)
    return first.unionByName(compare(held, ties, percent))


def _nodes(rows: DataFrame) -> DataFrame:
    """digest, node, label, n, stays: a number and the smallest doc_id of each distinct set of rows."""
    known = rows.filter("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("label"), F.max("n").alias("n"), F.max("stays").alias("stays"))
    # The numbers are written once, so they stay as they are.
    return stored(known.withColumn("node", F.monotonically_increasing_id()))


def linked(docs: DataFrame, percent: float = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n, digest), classes (digest, node, label, n) and links (u, v, jaccard: nodes) of docs."""
    ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    n_tokens = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    rows = stored(sift(docs, n_tokens, percent))
    nodes = _nodes(rows)
    kept = nodes.filter("stays").select(F.col("label").alias("_label"), "node", "digest")
    n_kept = kept.join(nodes.select("node", "n"), "node").agg(F.sum("n")).first()[0] or 0
    # Ids and digests are hashed, so that texts needn't be sorted.
    texts = docs.join(kept.hint("shuffle_hash"), F.col("doc_id") == F.col("_label")).select("node", "digest", "text")
    return rows, nodes, stored(links_of(texts, n_kept, percent))


def join_components(docs: DataFrame, percent: float = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: for each row the size of its set and the smallest doc_id that links reach."""
    rows, nodes, links = linked(docs, percent)
    # Sets of one doc_id belong together.
    several = rows.filter("n > 0 and doc_id is not null").select("doc_id", "digest").join(nodes.select("digest", "node"), "digest").groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("m"), F.collect_set("node").alias("all")).filter("v <> m")
    found = components(links.select("u", "v").unionByName(several.select(F.explode("all").alias("u"), "v")))
    roots = nodes.join(found, nodes["node"] == found["v"], "left").select("digest", "label", F.coalesce("root", "node").alias("root"))
    least = roots.groupBy("root").agg(F.min("label").alias("component_id"))
    of = roots.join(least, "root").select("digest", "component_id")
    out = rows.join(of, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, percent: float = 80) -> DataFrame:
    """docs without those that are linked, over any number of steps, to a document of smaller doc_id. Of rows that share
    a doc_id the one whose text comes first stays; of rows without a doc_id one of each text."""
    gone = join_components(docs, percent).filter("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    kept = docs.join(gone.hint("shuffle_hash"), docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
    key = [docs["doc_id"], F.when(docs["doc_id"].isNull(), F.sha2(text_of(), 256))]
    again = kept.groupBy(key[0].alias("_k"), key[1].alias("_t")).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    if again.isEmpty():
        return kept
    again = stored(again)
    same = key[0].eqNullSafe(F.col("_k")) & key[1].eqNullSafe(F.col("_t"))
    row = F.struct(*[kept[c] for c in docs.columns])
    first = kept.join(again, same).groupBy("_k", "_t").agg(F.min_by(row, F.struct(text_of(), F.to_json(row))).alias("_row"))
    return kept.join(again, same, "left_anti").unionByName(first.select("_row.*"))
