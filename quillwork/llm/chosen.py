"""Near-duplicates by a chosen-path set similarity join (after Christiani and Pagh, 2017, and Christiani, Pagh and Sivertsen, 2018).

Each text is its set of five-word shingles, and has AXES minwise tokens: two texts share the token of an axis with a probability that
is their similarity. TREES trees deal the texts to nodes: by the tokens of BRANCH axes at the root, and from each node too large to
compare by those of one axis, or in half of the nodes two, that the node's path chooses. A text has 1.5 copies a level, so that pairs
below 0.67 thin out, while a pair at 0.85 has 1.275. Such a pair is lost below a node with a probability q of 0.24 at most
(q = t (1 + t) / 2 with t = 0.15 + 0.85 q), and in all 12 nodes under the roots with (0.15 + 0.85 q)**12 = 4e-6.

Texts that have no link leave the trees before any set is looked at: a linked one shares MET of the axes of the roots, and MET_ALL of
all, with the same text, but with a probability of 3e-7 and 3e-8; most share fewer with any. Of the rest a text stays whose shingles are,
PERCENT of them, in others, which a link implies.

Nodes of up to SMALL texts are compared exhaustively. In a larger one all texts are compared with the leader, the text whose shingles are
the most frequent; if all are then of one component, the node is done; if up to SMALL texts aren't of its largest component, these
are compared with all others; else it branches, LEVELS times at most. What is left then, texts that are nearly alike in great numbers, is
settled exactly: of two linked texts the first shingle that both have, rarest first, stands early in either, so that texts of
different components that share such a one are compared, in cells of CELL. Whole shingle sets decide on every link. Equal sets are one text from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, in_arrow_batches, materialize, mix64, small_batches, trimmed
from .near import shingles

#: Links are pairs with 100 * intersection >= PERCENT * union.
PERCENT = 85
TREES, BRANCH, CHOICES, AXES = 6, 2, 4, 60
MET, MET_ALL = 3, 34
SMALL, CELL = 24, 4096
LEVELS = 1
#: Set ids of candidates are broadcast up to so many.
FEW = 1_000_000
_SLICE = 1 << 20
_FACTORS = np.random.Generator(np.random.PCG64(11)).integers(0, 2**63, AXES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sketches(batches):
    """doc_id, th, n (distinct shingles), sid (a hash of the set), tokens (AXES minwise tokens) of each text; without words n is 0."""
    for whole in batches:
        for batch in in_arrow_batches(whole, _SLICE):
            h, first = shingles(batch.column(1))
            own = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:])]
            n = np.array([len(x) for x in own], np.int64)
            full = np.flatnonzero(n)
            least, sid = np.zeros((len(full), AXES), np.uint64), np.zeros(batch.num_rows, np.uint64)
            if len(full):
                every, starts = np.concatenate([own[i] for i in full]), np.append(0, np.cumsum(n[full]))[:-1]
                for j, factor in enumerate(_FACTORS):
                    least[:, j] = np.minimum.reduceat(mix64(every * factor), starts)
                sid[full] = mix64(np.add.reduceat(mix64(every + np.uint64(7)), starts) + n[full].astype(np.uint64))
            bounds = np.zeros(batch.num_rows + 1, np.int32)
            bounds[full + 1] = AXES
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(bounds).astype(np.int32)), pa.array(least.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(sid.view(np.int64)), lists], ["doc_id", "th", "n", "sid", "tokens"])


def _sets(batches):
    for whole in batches:
        for batch in in_arrow_batches(whole, _SLICE):
            h, first = shingles(batch.column(1))
            own = [np.unique(h[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], ["sid", "own"])


def alike(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of a and b members with so many in common are linked."""
    return 100 * shared >= PERCENT * (a + b - shared)


def _linked(batches):
    """The pairs alike: the members of a pair are shifted by a number of its own, so that one search counts those of a whole batch."""
    for batch in batches:
        ends = [np.append(0, np.cumsum(pc.list_value_length(batch.column(k)).to_numpy(zero_copy_only=False))).astype(int) for k in (2, 3)]
        own = mix64(np.arange(1, batch.num_rows + 1, dtype=np.uint64))
        x, y = (batch.column(k).flatten().to_numpy(zero_copy_only=False).view(np.uint64) + np.repeat(own, np.diff(e)) for k, e in zip((2, 3), ends))
        y.sort()
        met = np.zeros(len(x), bool)
        if len(y):
            met = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x
        both = np.diff(np.append(0, np.cumsum(met))[ends[0]])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(alike(both, np.diff(ends[0]), np.diff(ends[1])), pa.bool_()))


def _sizes_fit(n: Column, m: Column) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT


def _meeting(tokens: DataFrame) -> DataFrame:
    """sid of the texts (sid, tokens) MET_ALL of whose tokens are in others too."""
    each = tokens.select("sid", F.posexplode("tokens").alias("axis", "token"))
    often = each.groupBy("axis", "token").agg(F.count("*").alias("k")).where("k > 1").select("axis", "token")
    return each.join(often, ["axis", "token"]).groupBy("sid").agg(F.count("*").alias("k")).where(F.col("k") >= MET_ALL).select("sid")


def _shared(sets: DataFrame) -> DataFrame:
    """sid, n, weight (mean frequency of its shingles) of the sets that may have a link: a link's intersection is PERCENT of the union or
    more, so that such a part of either set is in another one."""
    each = sets.select("sid", F.size("own").alias("n"), F.explode("own").alias("sh"))
    often = each.groupBy("sh").agg(F.count("*").alias("df")).where("df > 1")
    of = each.join(often, "sh").groupBy("sid", "n").agg(F.count("*").alias("shared"), F.sum("df").alias("df"))
    return of.where(F.col("shared") * 100 >= F.col("n") * PERCENT).select("sid", F.col("n").cast("long").alias("n"), (F.col("df") / F.col("n")).alias("weight"))


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def compared(pairs: DataFrame, sets: DataFrame, before: list[DataFrame]) -> DataFrame:
    """The pairs (a, b) of sets (sid, own) that are linked. before: the pairs already compared, which are left out; these join them."""
    pairs = pairs.distinct()
    for done in before:
        pairs = pairs.join(done, ["a", "b"], "left_anti")
    pairs = materialize(pairs, "chosen-pairs")
    before.append(pairs)
    both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("sid").alias("b"), F.col("own").alias("y")), "b").select("a", "b", "x", "y")
    return materialize(small_batches(both).mapInArrow(trimmed(_linked), "a long, b long"), "chosen-links")


def _children(rows: DataFrame, level: int) -> DataFrame:
    """node, sid, n, tokens: rows (node, sid, n, tokens) by the tokens of the axes that their nodes choose. At the root (level 0) each tree
    has axes of its own; below, a node takes one or two of the level's CHOICES axes, by its number."""
    if level == 0:
        axes = F.sequence(F.lit(0), F.lit(TREES * BRANCH - 1))
        axis = F.col("k")
        tree = F.floor(F.col("k") / BRANCH)
    else:
        axes = F.when(F.xxhash64("node", F.lit("two")) % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        start = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(CHOICES)).cast("int")
        step = F.pmod(F.xxhash64("node", F.lit(-level)), F.lit(CHOICES - 1)).cast("int") + 1
        axis = F.lit(TREES * BRANCH + (level - 1) * CHOICES) + (start + F.col("k") * step) % CHOICES
        tree = F.col("node")
    dealt = rows.withColumn("k", F.explode(axes)).withColumn("axis", axis.cast("int"))
    return dealt.select(F.xxhash64(tree, "axis", F.element_at("tokens", F.col("axis") + 1)).alias("node"), "sid", "n")


def _inhabited(rows: DataFrame) -> DataFrame:
    """rows (node, sid, n, c) of nodes that hold several components (c), with texts (the node's), top (its largest component) and rest
    (texts outside of it)."""
    of = rows.groupBy("node", "c").agg(F.count("*").alias("k")).groupBy("node").agg(F.sum("k").alias("texts"), F.max("k").alias("most"), F.max_by("c", F.struct("k", "c")).alias("top"))
    of = of.where("texts > most").select("node", "texts", "top", (F.col("texts") - F.col("most")).alias("rest"))
    return rows.join(materialize(of, "chosen-nodes"), "node")


def _exhaustive(rows: DataFrame) -> DataFrame:
    """Pairs of different components in each node of rows: those outside the largest component meet all others. Nodes are dealt to cells
    of CELL texts, so that no task holds a large one."""
    cells = F.ceil(F.col("texts") / CELL)
    ahead = rows.where("c <> top").select("node", F.explode(F.sequence(F.lit(0).cast("long"), cells - 1)).alias("cell"), F.col("sid").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx"))
    dealt = rows.select("node", F.pmod(F.xxhash64("sid"), cells).alias("cell"), "sid", "c", "n")
    return ahead.join(dealt, ["node", "cell"]).where((F.col("c") != F.col("cx")) & _sizes_fit(F.col("n"), F.col("nx"))).select(*_pair("x", "sid"))


def _early(left: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of different components among the texts of left (sid, n, c) whose first common shingle, rarest first, may stand as early in
    both as it does in two linked texts: so many shingles from it on must be left."""
    texts = left.select("sid", "n", "c").distinct()
    each = sets.join(texts, "sid").select("sid", "n", "c", F.explode("own").alias("node"))
    often = each.groupBy("node").agg(F.count("*").alias("df")).where("df > 1")
    of = Window.partitionBy("sid")
    ranked = each.join(often, "node").select("sid", "n", "c", "node", (F.count("*").over(of) - F.row_number().over(of.orderBy("df", "node")) + 1).alias("left"))
    rows = _inhabited(materialize(ranked.where(F.col("left") * 100 >= F.col("n") * PERCENT), "chosen-early"))
    cells = F.ceil(F.col("texts") / CELL)
    ahead = rows.where("c <> top").select("node", F.explode(F.sequence(F.lit(0).cast("long"), cells - 1)).alias("cell"), F.col("sid").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx"), F.col("left").alias("lx"))
    dealt = rows.select("node", F.pmod(F.xxhash64("sid"), cells).alias("cell"), "sid", "c", "n", "left")
    enough = F.least("left", "lx") * (100 + PERCENT) >= (F.col("n") + F.col("nx")) * PERCENT
    return ahead.join(dealt, ["node", "cell"]).where((F.col("c") != F.col("cx")) & enough).select(*_pair("x", "sid"))


def _led(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Pairs of each node's leader with its texts of other components."""
    lead = rows.join(weights, "sid").groupBy("node").agg(F.max_by(F.struct("sid", "n", "c"), F.struct("weight", "sid")).alias("lead"))
    return rows.join(lead, "node").where((F.col("c") != F.col("lead.c")) & _sizes_fit(F.col("n"), F.col("lead.n"))).select(F.least("sid", "lead.sid").alias("a"), F.greatest("sid", "lead.sid").alias("b"))


def _named(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """rows with c, the component of their sid."""
    if roots is None:
        return rows.withColumn("c", F.col("sid"))
    return rows.join(roots.select(F.col("node").alias("sid"), F.col("root").alias("r")), "sid", "left").withColumn("c", F.coalesce("r", "sid")).drop("r")


def _united(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    edges = links if roots is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links)
    return components(edges, "chosen-cc")


def joined(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """node, root: the components of all linked pairs among the sets of nodes (sid, n, tokens; each sid once); sets alone are missing.

    texts: sid, text of all nodes (repeated rows do no harm).
    """
    dealt = materialize(_children(nodes, 0), "chosen-dealt")
    met = dealt.groupBy("node").agg(F.count("*").alias("k")).where("k > 1").select("node")
    rows = materialize(dealt.join(met, "node"), "chosen-rows")
    discard(dealt)
    many = materialize(rows.groupBy("sid").agg(F.count("*").alias("k")).where(F.col("k") >= MET).select("sid"), "chosen-many")
    needed = materialize(_meeting(nodes.select("sid", "tokens").join(F.broadcast(many) if many.count() <= FEW else many, "sid", "left_semi")), "chosen-needed")
    discard(many)
    candidates = needed.count()
    named = F.broadcast(needed) if candidates <= FEW else needed
    sets = materialize(small_batches(texts.join(named, "sid", "left_semi").dropDuplicates(["sid"]).select("sid", "text")).mapInArrow(trimmed(_sets), "sid long, own array<long>"), "chosen-sets")
    weights = materialize(_shared(sets), "chosen-weights")
    alive = weights.select("sid")
    alive = F.broadcast(alive) if candidates <= FEW else alive
    dealt, rows = rows, materialize(rows.join(alive, "sid", "left_semi"), "chosen-rows")
    discard(dealt)
    tokens = nodes.join(alive, "sid", "left_semi").select("sid", "tokens")
    roots, before = None, []
    for level in range(LEVELS + 1):
        now = materialize(_inhabited(_named(rows, roots)), "chosen-open")
        large = now.where(F.col("texts") > SMALL)
        pairs = _exhaustive(now.where(F.col("texts") <= SMALL))
        if large.limit(1).count():
            pairs = pairs.unionByName(_led(large, weights.select("sid", "weight")))
        roots = materialize(_united(roots, compared(pairs, sets, before)), "chosen-roots")
        left = materialize(_inhabited(_named(large.select("node", "sid", "n"), roots)), "chosen-left")
        open_ = left.where(F.col("rest") > SMALL)
        going, close = bool(open_.limit(1).count()), left.where(F.col("rest") <= SMALL)
        pairs = _exhaustive(close)
        if going and level == LEVELS:
            pairs = pairs.unionByName(_early(open_, sets))
        if close.limit(1).count() or going and level == LEVELS:
            roots = materialize(_united(roots, compared(pairs, sets, before)), "chosen-roots")
        if not going or level == LEVELS:
            break
        discard(rows)
        rows = materialize(_children(open_.select("node", "sid", "n").join(tokens, "sid"), level + 1), "chosen-rows")
        discard(now)
        discard(left)
    for done in (sets, weights, rows, *before):
        discard(done)
    return roots


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs: texts linked at PERCENT or more, by the trees above.

    A text's set is its distinct five-word shingles, A-Z lower-cased; fewer words are one shingle. Null and empty texts and those without
    words have no set and are alone: component_id is their doc_id. component_id is else the smallest doc_id reachable; a null
    doc_id never names a component unless all its ids are null; kept is whether both are equal, nulls too. Repeated rows come out as often as
    they go in; other columns of docs, whatever their names, aren't looked at; a very long text comes alone in its batch; an empty
    table gives an empty result.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    own = materialize(small_batches(rows).mapInArrow(trimmed(_sketches), "doc_id long, th long, n long, sid long, tokens array<long>"), "chosen-sketches")
    worded = own.where("n > 0")
    nodes = materialize(worded.groupBy("sid").agg(F.min(F.struct("n", "th", "tokens")).alias("one"), F.min("doc_id").alias("least")).select("sid", "one.*", "least"), "chosen-nodes")
    texts = rows.select("th", "text").join(nodes.select("th", "sid"), "th").select("sid", "text")
    roots = joined(nodes.select("sid", "n", "tokens"), texts)
    of = nodes.select("sid", "least").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = materialize(of.join(least, "root").select("sid", "component_id"), "chosen-components")
    out = own.select("doc_id", "n", "sid").join(of, "sid", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
