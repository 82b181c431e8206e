"""Near copies by the similarity of five-word shingles, beside SimHash: the fingerprints of pairs at 0.8 differ in about ten bits of
64, a radius that no covering masks reach with usable buckets.

Min-hash bands find the texts that may be alike (a pair at 0.8 meets in one of 32 bands of 4 with probability 1 - 5e-8), and the whole
shingle sets decide. Each text of a bucket is compared with one of them, the leader, whose shingles are the most frequent: it joins most
of a group of copies. What is left is found by prefixes: a pair of similarity 0.8 shares at least 4/9 of its two sizes, so that, with
the shingles of each text ordered from the rarest, its first common one stands early in both (PPJoin; Xiao et al., 2008). Texts of
different components that share such a shingle at such places are compared; shingles that one text alone has come first and meet none,
so that a text with many of its own meets few others or none, however large its group. In a prefix bucket of more than SMALL texts,
LEADERS of those outside its largest component lead in turn, then LEADERS times as many, until a bucket is one component or all have
led: no link between components is lost, and within a component none is looked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tokens, components, discard, in_arrow_batches, materialize, mix64, small_batches, trimmed, window_hash
from .simhash import _grouped, fingerprint, one_of_each

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, SMALL = 32, 4, 32
LEADERS, CELL = 16, 4096
FEW = 1_000_000
_SLICE = 1 << 20
_FACTORS = np.random.Generator(np.random.PCG64(5)).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the SHINGLE-word shingles (A-Z lower-cased; fewer words: all of them) of each text, one text after the other, and
    where each text's begin (one more entry than texts)."""
    t = Tokens(texts, lower=True)
    size = np.diff(t.first)
    h = window_hash(t.hash, SHINGLE)
    inside = np.flatnonzero(t.doc[: len(h)] == t.doc[SHINGLE - 1 :]) if len(h) else np.zeros(0, int)
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    own = [window_hash(t.hash[t.first[d] : t.first[d + 1]], int(size[d])) for d in short]
    doc = np.concatenate([t.doc[inside], short]).astype(int)
    every = np.concatenate([h[inside], *own]) if own else h[inside]
    order = np.argsort(doc, kind="stable")
    return every[order], np.searchsorted(doc[order], np.arange(t.n + 1))


def _sketches(batches):
    """doc_id, th, fp and the band keys of each text."""
    for whole in batches:
        for batch in in_arrow_batches(whole, _SLICE):
            h, first = shingles(batch.column(1))
            full = np.flatnonzero(np.diff(first))
            least = np.zeros((len(full), BANDS * ROWS), np.uint64)
            for j, factor in enumerate(_FACTORS if len(full) else ()):
                least[:, j] = np.minimum.reduceat(h * factor, first[:-1][full])
            keys = np.zeros((len(full), BANDS), np.uint64)
            for k in range(ROWS):
                keys = mix64(keys + least[:, k::ROWS] + np.uint64(k + 1))
            bounds = np.zeros(batch.num_rows + 1, np.int32)
            bounds[full + 1] = BANDS
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(bounds).astype(np.int32)), pa.array(keys.ravel().view(np.int64)))
            fp = np.array([fingerprint((x or "").encode()) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp.view(np.int64)), lists], ["doc_id", "th", "fp", "bands"])


def _sets(batches):
    for whole in batches:
        for batch in in_arrow_batches(whole, _SLICE):
            h, first = shingles(batch.column(1))
            own = [np.unique(h[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], ["th", "own"])


def _similar(batches):
    """The pairs alike: the hashes of a pair are shifted by a number of its own, so that one search counts those of a whole batch."""
    for batch in batches:
        ends = [np.append(0, np.cumsum(pc.list_value_length(batch.column(k)).to_numpy(zero_copy_only=False))).astype(int) for k in (2, 3)]
        own = mix64(np.arange(1, batch.num_rows + 1, dtype=np.uint64))
        x, y = (batch.column(k).flatten().to_numpy(zero_copy_only=False).view(np.uint64) + np.repeat(own, np.diff(e)) for k, e in zip((2, 3), ends))
        y.sort()
        met = np.zeros(len(x), bool)
        if len(y):
            met = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x
        both = np.diff(np.append(0, np.cumsum(met))[ends[0]])
        ok = both >= SIMILARITY * (np.diff(ends[0]) + np.diff(ends[1]) - both)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets (th, own) are alike."""
    pairs = materialize(pairs.distinct(), "near-pairs")
    both = pairs.join(sets.select(F.col("th").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("th").alias("b"), F.col("own").alias("y")), "b").select("a", "b", "x", "y")
    found = materialize(small_batches(both).mapInArrow(trimmed(_similar), "a long, b long"), "near-links")
    discard(pairs)
    return found


def _enough(shared: Column, sizes: Column) -> Column:
    """Whether two sets of these sizes together may be of similarity SIMILARITY with so many shingles in common."""
    return shared * (1 + SIMILARITY) >= sizes * SIMILARITY - 1e-6


def _prefixes(sets: DataFrame) -> DataFrame:
    """th, n (size of the set), shared (shingles that another set has), weight (mean frequency of its shingles), sh, left: a row for
    each shingle sh that may be the rarest a text has in common with one alike; left counts it and those after it.

    Shingles are ordered by their number of sets, then by themselves; those of one set alone come first and are not listed. A text
    has no rows if too few of its shingles are shared, and then none is like it; else at least one.
    """
    each = sets.select("th", F.size("own").alias("n"), F.explode("own").alias("sh"))
    often = each.groupBy("sh").agg(F.count("*").alias("df")).where("df > 1")
    of = Window.partitionBy("th")
    ranked = each.join(often, "sh").select(
        "th", "n", "sh", F.count("*").over(of).alias("shared"), (F.sum("df").over(of) / F.col("n")).alias("weight"), F.row_number().over(of.orderBy("df", "sh")).alias("nth"))
    left = F.col("shared") - F.col("nth") + 1
    return ranked.select("th", "n", "shared", "weight", "sh", "nth", left.alias("left")).where(left >= F.col("n") * SIMILARITY - 1e-6)


def _led(rows: DataFrame, roots: DataFrame, most: int) -> tuple[DataFrame, DataFrame] | None:
    """One round over the buckets of rows (sh, th, n, left) that hold several components (roots: node, root): the pairs of about most
    leaders a bucket with its members in other components, and the rows left when the leaders, which met all they had to, leave.

    Leaders come from outside the largest component of a bucket, since one end of any link between components lies there. Members of
    a bucket are dealt to cells of CELL, and leaders copied to each, so that no task holds a hot bucket. None: nothing is left.
    """
    marked = materialize(rows.join(roots.withColumnRenamed("node", "th"), "th", "left").select("sh", "th", "n", "left", F.coalesce("root", "th").alias("c")), "near-marked")
    sizes = marked.groupBy("sh", "c").agg(F.count("*").alias("texts")).groupBy("sh").agg(F.max_by("c", "texts").alias("top"), F.max("texts").alias("first"), F.sum("texts").alias("texts"))
    sizes = sizes.where("texts > first").select("sh", "top", F.when(F.col("texts") > SMALL, F.col("texts") - F.col("first")).otherwise(0).alias("rest"), F.ceil(F.col("texts") / CELL).alias("cells"))
    sizes = materialize(sizes, "near-buckets")
    if not sizes.limit(1).count():
        return None
    turn = (F.col("rest") == 0) | (F.pmod(F.xxhash64("th", F.lit(most)), F.greatest(F.ceil(F.col("rest") / most), F.lit(1))) == 0)
    members = marked.join(sizes, "sh").withColumn("leads", (F.col("c") != F.col("top")) & turn)
    leaders = members.where("leads").select("sh", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("cell"), F.col("th").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx"), F.col("left").alias("lx"))
    dealt = members.select("sh", F.pmod(F.xxhash64("th"), F.col("cells")).alias("cell"), "th", "c", "n", "left")
    may = (F.col("c") != F.col("cx")) & _enough(F.least("left", "lx"), F.col("n") + F.col("nx"))
    pairs = leaders.join(dealt, ["sh", "cell"]).where(may).select(F.least("x", "th").alias("a"), F.greatest("x", "th").alias("b"))
    return pairs, members.where("not leads").select("sh", "th", "n", "left")


def similar_links(nodes: DataFrame, texts: DataFrame, known: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of known and of all pairs of similarity SIMILARITY or more among nodes (th, bands).

    texts: th, text of all nodes (more rows do no harm). Texts without words have no bands and no links of their own. The ids of texts
    that share a band are counted: up to FEW are broadcast, so that only these texts move; beyond, the join shuffles.
    """
    rows = materialize(nodes.select("th", F.posexplode("bands").alias("band", "key")), "near-bands")
    met = materialize(rows.join(rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key"), ["band", "key"]), "near-met")
    discard(rows)
    needed = materialize(met.select("th").distinct(), "near-needed")
    named = F.broadcast(needed) if needed.count() <= FEW else needed
    sets = materialize(small_batches(texts.join(named, "th", "left_semi").dropDuplicates(["th"]).select("th", "text")).mapInArrow(trimmed(_sets), "th long, own array<long>"), "near-sets")
    discard(needed)
    left = materialize(_prefixes(sets), "near-prefixes")
    met = met.join(left.where("nth = 1").select("th", "n", "shared", "weight"), "th")
    lead = met.groupBy("band", "key").agg(F.max_by(F.struct("th", "n", "shared"), F.struct("weight", "th")).alias("lead"))
    may = (F.col("th") != F.col("lead.th")) & _enough(F.least("shared", "lead.shared"), F.col("n") + F.col("lead.n"))
    pairs = met.join(lead, ["band", "key"]).where(may).select(F.least("th", "lead.th").alias("a"), F.greatest("th", "lead.th").alias("b"))
    roots, most = components(known.unionByName(_compared(pairs, sets))), LEADERS
    while (led := _led(left, roots, most)) is not None:
        found = _compared(led[0], sets)
        if found.limit(1).count():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))
        after = materialize(led[1], "near-left")
        discard(left)
        left, most = after, most * LEADERS
    discard(sets)
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), group for each row of docs: texts joined by SimHash (see simhash) or by five-word shingles."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    own = materialize(small_batches(rows).mapInArrow(trimmed(_sketches), "doc_id long, th long, fp long, bands array<long>"), "near-sketches")
    by = materialize(own.select("doc_id", "th", "fp").join(materialize(_grouped(own.select("doc_id", "th", "fp")), "near-groups").select("fp", "root"), "fp").select("doc_id", "th", "root"), "near-roots")
    alike = by.select("th", "root").distinct()
    first = alike.groupBy("root").agg(F.min("th").alias("a"))
    same = alike.join(first, "root").where("a < th").select("a", F.col("th").alias("b"))
    links = similar_links(own.select("th", "bands").dropDuplicates(["th"]), rows.select("th", "text"), materialize(same, "near-links"))
    joined = components(links).select(F.col("node").alias("th"), F.col("root").alias("r"))
    return by.join(joined, "th", "left").select("doc_id", "th", F.coalesce("r", "th").alias("group"))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs, whole, that stay when one document of each group does: see groups() and simhash.one_of_each().

    Null and empty texts are one group; repeated rows are copies; null ids count as the largest; docs may have columns of any names;
    a very long text comes alone in its batch; an empty table gives an empty result.
    """
    return one_of_each(docs, groups(docs))
