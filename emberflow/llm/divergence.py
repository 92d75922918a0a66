"""How far the sources of a language lie apart in the words they use, and which words mark each source.

Each group (lang, source) gives each kept term t the share p = 1 + floor(scale * (count + prior) / (N + prior * V)),
a whole number. The distance of two groups is the sum of |p - q| over all V terms, most of which neither uses, so it
isn't summed term by term. With z for the share of a count of 0 it is, exactly,

    sum over a's terms of |p - z_b|  +  sum over b's terms of |q - z_a|  +  (V - n_a - n_b) * |z_a - z_b|
    +  sum over common terms of |p - q| - |p - z_b| - |q - z_a| + |z_a - z_b|

The first two sums are priced from a histogram of each group's counts, the third is a constant, and only the last
needs terms: postings (term, group) meet those of the same term and are added up by pair before they are shuffled.

Cases: null text, lang and source are ''; a group without terms and a language without kept terms have their rows (a
distance of 0 where V = 0); a source alone in its language has no pairs; equal rows count each; ties are broken by item
in order of UTF-8 bytes; an empty table gives no rows; other columns aren't read. Counts stay exact below 10^18.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberflow.llm import arrays
from emberflow.llm.common import ready, small, stored, text_of

#: Bytes of text whose counts a task adds up before it hands them on.
BLOCK = 1 << 24
#: A term is a run of ASCII letters and of bytes above 0x7F; everything else parts terms.
_PART = np.ones(256, bool)
_PART[65:91] = _PART[97:123] = _PART[128:] = False
_PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Every term of the texts, in order, with A-Z lower-cased, and the row it stands in."""
    data, offs = arrays.raw(texts)
    data = arrays._LOWER.astype(np.uint8)[data]
    start, end = arrays._edges(data, offs, _PART)
    ends = np.concatenate([[0], np.cumsum(end - start)])
    found = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data[~_PART[data]])])
    return found, np.searchsorted(offs, start, "right") - 1


def _partial(texts: pa.Array, group: np.ndarray) -> pa.Table:
    """Occurrences and documents of each term in each group of rows."""
    found, row = terms(texts)
    coded = found.dictionary_encode()
    v = max(1, len(coded.dictionary))
    cell, n = np.unique(row * v + coded.indices.to_numpy(), return_counts=True)
    cell, at = np.unique(group[cell // v] * v + cell % v, return_inverse=True)
    return pa.table({"g": cell // v, "term": coded.dictionary.take(pa.array(cell % v)).cast(pa.string()), "n": np.bincount(at, n, len(cell)).astype(np.int64), "df": np.bincount(at, minlength=len(cell)).astype(np.int64)})


def _count(batches):
    """Rows of _PARTIAL, added up over about BLOCK bytes of text."""
    names, held, size = {}, [], 0

    def out():
        added = pa.concat_tables(held).group_by(["g", "term"], use_threads=False).aggregate([("n", "sum"), ("df", "sum")])
        lang, source = (pa.array([k[i] for k in names], pa.string()) for i in (0, 1))
        cols = [lang.take(added["g"].combine_chunks()), source.take(added["g"].combine_chunks()), added["term"], added["n_sum"], added["df_sum"]]
        return pa.table(cols, schema=_PARTIAL).to_batches(max_chunksize=1 << 15)

    for b in small(batches):
        for at, texts in arrays.pieces(b["text"]):
            own = b.slice(at, len(texts))
            group = np.array([names.setdefault(k, len(names)) for k in zip(own["lang"].to_pylist(), own["source"].to_pylist())], np.int64)
            held.append(_partial(texts, group))
            size += texts.nbytes
            if size >= BLOCK:
                yield from out()
                names, held, size = {}, [], 0
    if held:
        yield from out()


def share(n: Column, total: Column, v: Column, prior: int, scale: int) -> Column:
    """1 + floor(scale * (n + prior) / (total + prior * v)), in whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(18,0)")
    over = F.lit(scale).cast("decimal(12,0)") * (wide(n) + F.lit(prior).cast("decimal(6,0)"))
    under = wide(total) + F.lit(prior).cast("decimal(6,0)") * wide(v)
    return F.call_function("div", over, under) + F.lit(1)


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50, prior: int = 5, scale: int = 10**9) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` has the distance to each other source of the language, part
    `term` the `top` terms whose share in the group exceeds that in the language by most."""
    ready(docs.sparkSession)
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(named("lang"), named("source"), text_of().alias("text"))
    partial = rows.mapInArrow(_count, "lang string, source string, term string, n long, df long")
    counts = stored(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")))
    vocab = counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("of_lang")).filter(F.col("df") >= least_docs)
    kept = stored(counts.drop("df").join(vocab.drop("df"), ["lang", "term"]))

    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    words = kept.dropDuplicates(["lang", "term"]).groupBy("lang").agg(F.count("*").alias("v"), F.sum("of_lang").alias("lang_total"))
    none = F.lit(0).cast("long")
    filled = [F.coalesce(c, none).alias(c) for c in ("total", "k", "v", "lang_total")]
    groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(words, "lang", "left").select("lang", "source", *filled)
    # A language without kept terms has no shares at all.
    groups = stored(groups.withColumn("z", F.when(F.col("v") > 0, share(none, F.col("total"), F.col("v"), prior, scale)).otherwise(none)))
    posts = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v"), prior, scale))

    marks = posts.withColumn("value", F.col("p") - share(F.col("of_lang"), F.col("lang_total"), F.col("v"), prior, scale)).filter("value > 0")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    marks = marks.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", F.row_number().over(best).alias("rank")).filter(F.col("rank") <= top)
    return distances(groups, posts).unionByName(marks)


def distances(groups: DataFrame, posts: DataFrame) -> DataFrame:
    """Part `pair` of the audit, for groups (lang, source, k, v, z) and postings (lang, term, source, p, z)."""
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    sides = ["source", "k", "z"]
    a, b = (groups.select("lang", *[F.col(c).alias(f"{c}_{s}") for c in sides], *(["v"] if s == "a" else [])) for s in "ab")
    both = a.join(b, "lang").filter("source_a <> source_b")
    pairs = both.filter("source_a < source_b")

    bars = posts.groupBy("lang", F.col("source").alias("source_a"), "p").agg(F.count("*").alias("h"))
    one_sided = bars.join(both.select("lang", "source_a", "source_b", "z_b"), ["lang", "source_a"]).groupBy("lang", "source_a", "source_b").agg(F.sum(F.col("h") * gap("p", "z_b")).alias("priced"))
    ordered = one_sided.select("lang", F.least("source_a", "source_b").alias("source_a"), F.greatest("source_a", "source_b").alias("source_b"), "priced")
    priced = ordered.groupBy("lang", "source_a", "source_b").agg(F.sum("priced").alias("priced"))

    x, y = (posts.select("lang", "term", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "p", "z")]) for s in "ab")
    common = x.join(y, ["lang", "term"]).filter("source_a < source_b")
    common = common.groupBy("lang", "source_a", "source_b").agg(F.sum(gap("p_a", "p_b") - gap("p_a", "z_b") - gap("p_b", "z_a") + gap("z_a", "z_b")).alias("corrected"))

    keys = ["lang", "source_a", "source_b"]
    zero = F.lit(0).cast("long")
    value = F.coalesce("priced", zero) + F.coalesce("corrected", zero) + (F.col("v") - F.col("k_a") - F.col("k_b")) * gap("z_a", "z_b")
    found = pairs.join(priced, keys, "left").join(common, keys, "left").select(*keys, value.alias("value"))
    there, back = (found.select("lang", F.col(s).alias("source"), F.col(i).alias("item"), "value") for s, i in (keys[1:], keys[:0:-1]))
    far = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return there.unionByName(back).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(far).alias("rank"))
