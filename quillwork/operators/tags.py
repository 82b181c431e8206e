"""Edits to token tags and back; statistics of tags."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions import twister
from quillwork.functions.counters import Counters
from quillwork.functions.tables import numbered
from quillwork.functions.text import let, strip_space, tokens

KEEP, DELETE, APPEND, REPLACE, MORPH = "$KEEP", "$DELETE", "$APPEND", "$REPLACE", "$MORPH"

# Error types by base tag, generations A and B. Types that are not listed are replacements.
GENERATION_A = {
    KEEP: ("correct",),
    REPLACE: ("R:SPELL", "R:ORTH", "R:OTHER", "R:PROPN", "R:DET", "R:VERB:TENSE", "R:ADJ", "R:ADV", "R:PUNCT", "R:NOUN", "R:WO"),
    MORPH: ("R:MORPH",),
    APPEND: ("M:OTHER", "M:DET", "M:VERB:TENSE", "M:PUNCT", "M:PROPN", "M:ADV", "M:ADJ", "M:NOUN"),
    DELETE: ("U:OTHER", "U:PROPN", "U:DET", "U:ADV", "U:ADJ", "U:VERB:TENSE", "U:PUNCT", "U:NOUN"),
}
GENERATION_B = {
    KEEP: ("correct",),
    DELETE: ("U:PUNCT", "U:NOUN", "U:VERB", "U:ADJ", "U:ADV", "U:ADP", "U:SCONJ", "U:PROPN", "U:OTHER"),
    APPEND: ("M:PUNCT", "M:NOUN", "M:VERB", "M:ADJ", "M:ADV", "M:ADP", "M:SCONJ", "M:PROPN", "M:DET", "M:OTHER"),
    "$REPLACE_SPELL": ("R:SPELL", "R:ORTH", "R:PUNCT"),
    "$REPLACE_VERB": ("R:VERB", "R:VERB:FORM", "R:VERB:TENSE", "R:VERB:SVA"),
    "$REPLACE_NOUN": ("R:NOUN", "R:NOUN:FORM", "R:NOUN:NUM"),
    "$REPLACE_ADJ": ("R:ADJ", "R:ADJ:FORM"),
    REPLACE: ("R:PRON", "R:DET", "R:ADP", "R:PREP", "R:SCONJ", "R:ADV", "R:PROPN", "R:PROPN:FORM", "R:MORPH", "R:WO", "R:OTHER"),
}
#: Base tags in the order in which a full tag is tested for them.
BASES = (KEEP, DELETE, APPEND, "$REPLACE_SPELL", "$REPLACE_VERB", "$REPLACE_NOUN", "$REPLACE_ADJ", REPLACE)


def base_for(err_type: Column, generation: dict = GENERATION_B, strict: bool = True) -> Column:
    """The base tag of an error type. strict=False sends unlisted M: and U: types to append and delete instead of replace."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for base, types in generation.items():
        out = out.when(err_type.isin(*types), base)
    if not strict:
        out = out.when(err_type.startswith("M:"), APPEND).when(err_type.startswith("U:"), DELETE)
    return out.otherwise(REPLACE)


def full_tag(base: Column, correction: Column, none_is_empty: bool = True) -> Column:
    """base_correction; keeps and deletions stay bare, as do tags without a correction (and, in B, with -NONE-)."""
    cor = strip_space(F.coalesce(correction, F.lit("")))
    bare = base.isin(KEEP, DELETE) | (cor == "")
    return F.when(bare | (cor == "-NONE-") if none_is_empty else bare, base).otherwise(F.concat_ws("_", base, cor))


def _fill(n: Column, marks: Column) -> Column:
    """n tags from marks array<struct<pos,ord,tag>>: the last mark of a place counts, places without one are keeps. Linear in n."""
    empty = F.array().cast("array<string>")
    inside = F.array_sort(F.filter(marks, lambda m: (m["pos"] >= 0) & (m["pos"] < n)))

    def lay(d: Column) -> Column:
        def piece(x: Column, k: Column) -> Column:
            before = F.when(k > 0, F.try_element_at(d, F.greatest(k, F.lit(1)))["pos"]).otherwise(F.lit(-1))
            return F.concat(F.array_repeat(F.lit(KEEP), x["pos"] - before - 1), F.array(x["tag"]))

        last = F.when(F.size(d) > 0, F.try_element_at(d, F.lit(-1))["pos"]).otherwise(F.lit(-1))
        return F.concat(F.coalesce(F.flatten(F.transform(d, piece)), empty), F.array_repeat(F.lit(KEEP), n - last - 1))

    return let(inside, lambda s: let(F.filter(s, lambda x, k: ~F.coalesce(F.try_element_at(s, k + 2)["pos"] == x["pos"], F.lit(False))), lay))


def _range(start: Column, end: Column) -> Column:
    return F.when(end > start, F.sequence(start, F.greatest(end - 1, start))).otherwise(F.array().cast("array<int>"))


def _mark(pos: Column, order: Column, tag: Column) -> Column:
    return F.struct(pos.cast("int").alias("pos"), order.cast("int").alias("ord"), tag.alias("tag"))


def edits_to_tags(toks: Column, edits: Column, strict: bool = True) -> Column:
    """Generation B: a tag per token from edits array<struct<start,end,err_type,correction>>; a later edit overwrites.

    Deletions fill their span, insertions stand on the token before (on the first if there is none), replacements on their
    first token with deletions after it.
    """

    def marks(e: Column, k: Column) -> Column:
        base = base_for(e["err_type"], GENERATION_B, strict)
        tag = full_tag(base, e["correction"])
        deleted = F.transform(_range(F.when(base == DELETE, e["start"]).otherwise(e["start"] + 1), e["end"]), lambda i: _mark(i, k, F.lit(DELETE)))
        first = F.array(_mark(F.when(base == APPEND, F.greatest(e["start"] - 1, F.lit(0))).otherwise(e["start"]), k, tag))
        return F.when(base == DELETE, deleted).when(base == APPEND, first).otherwise(F.concat(first, deleted))

    return let(toks, lambda t: _fill(F.size(t), F.flatten(F.transform(F.filter(edits, lambda e: e["err_type"] != "noop"), marks))))


def edits_to_tags_a(toks: Column, edits: Column) -> Column:
    """Generation A, from edits array<struct<start,end,tag>> in row order: an empty span is a bare append on the token before
    (none at the start), spans out of bounds are skipped, longer spans delete their further tokens."""

    def build(t: Column) -> Column:
        n = F.size(t)

        def marks(e: Column, k: Column) -> Column:
            deleted = F.transform(_range(e["start"] + 1, e["end"]), lambda i: _mark(i, k, F.lit(DELETE)))
            inside = (e["start"] < n) & (e["end"] <= n) & (e["end"] > e["start"])
            none = F.array().cast("array<struct<pos:int,ord:int,tag:string>>")
            return F.when(e["start"] == e["end"], F.array(_mark(e["start"] - 1, k, F.lit(APPEND)))).when(inside, F.concat(F.array(_mark(e["start"], k, e["tag"])), deleted)).otherwise(none)

        return _fill(n, F.flatten(F.transform(edits, marks)))

    return let(toks, build)


def reconstruct_target(toks: Column, edits: Column) -> Column:
    """The edits applied from right to left (stable by start): delete, insert one string, or replace by words. Edits apart from each other,
    as nearly all are, are laid with what lies between them in one pass; others are applied one after another."""
    none = F.array().cast("array<string>")

    def placed(e: Column) -> Column:
        base, cor = base_for(e["err_type"]), strip_space(e["correction"])
        new = F.when(base == DELETE, none).when(base == APPEND, F.array(cor)).otherwise(tokens(cor))
        return F.struct(e["start"].alias("start"), F.when(base == APPEND, e["start"]).otherwise(F.greatest(e["end"], e["start"])).alias("upto"), new.alias("new"))

    def laid(t: Column, s: Column) -> Column:
        n, last = F.size(t), F.coalesce(F.get(s, F.size(s) - 1)["upto"], F.lit(0))
        before = lambda i: F.coalesce(F.get(s, i - 1)["upto"], F.lit(0))
        apart = F.forall(F.transform(s, lambda x, i: (x["start"] >= before(i)) & (x["upto"] <= n) & ((i == 0) | (x["start"] > F.get(s, i - 1)["start"]))), lambda ok: ok)
        pieces = F.transform(s, lambda x, i: F.concat(F.slice(t, before(i) + 1, F.greatest(x["start"] - before(i), F.lit(0))), x["new"]))
        whole = F.flatten(F.concat(pieces, F.array(F.slice(t, last + 1, F.greatest(n - last, F.lit(0))))))
        return F.when(apart, F.array_join(whole, " ")).otherwise(_one_by_one(t, edits))

    real = F.filter(edits, lambda e: e["err_type"] != "noop")
    return let(F.struct(toks.alias("t"), F.array_sort(F.transform(real, placed)).alias("s")), lambda x: laid(x["t"], x["s"]))


def _one_by_one(toks: Column, edits: Column) -> Column:
    order = F.array_sort(F.transform(edits, lambda e, i: F.struct((-e["start"]).alias("k"), i.alias("i"), e.alias("e"))))

    def apply(acc: Column, x: Column) -> Column:
        e = x["e"]
        base, cor = base_for(e["err_type"]), strip_space(e["correction"])
        size = F.size(acc)
        start = F.least(e["start"], size)
        end = F.least(F.greatest(e["end"], start), size)
        left = F.when(start > 0, F.slice(acc, 1, start)).otherwise(F.array().cast("array<string>"))
        new = F.when(base == DELETE, F.array().cast("array<string>")).when(base == APPEND, F.array(cor)).otherwise(tokens(cor))
        upto = F.when(base == APPEND, start).otherwise(end)
        right = F.when(size > upto, F.slice(acc, upto + 1, size)).otherwise(F.array().cast("array<string>"))
        return F.when(e["err_type"] == "noop", acc).otherwise(F.concat(left, new, right))

    return F.array_join(F.aggregate(order, toks, apply), " ")


def base_of(tag: Column) -> Column:
    """The base of a full tag: the first base it begins with; others are keeps."""
    out = F.when(tag.startswith(KEEP), KEEP)
    for base in BASES[1:]:
        out = out.when(tag.startswith(base), base)
    return out.otherwise(KEEP)


def correction_of(tag: Column, compat_v2: bool = False) -> Column:
    """What follows the base and an underscore, else null: $REPLACE_VERBE replaces by VERBE and is no $REPLACE_VERB. compat_v2: the third
    part of a split at underscores, for replacements."""
    base = base_of(tag)
    for whole in reversed(BASES[1:]):
        base = F.when((tag == whole) | tag.startswith(whole + "_"), whole).otherwise(base)
    after = F.substr(tag, F.length(base) + 2, F.length(tag))
    found = F.when(~base.isin(KEEP, DELETE) & tag.startswith(F.concat(base, F.lit("_"))) & (F.length(tag) > F.length(base) + 1), after)
    if compat_v2:
        return F.when(base.isin(KEEP, DELETE), F.lit(None)).when(base == APPEND, found).otherwise(F.try_element_at(F.split(tag, "_", 3), F.lit(3)))
    return found


def apply_tags(toks: Column, tags: Column) -> Column:
    """The corrected sentence; tokens beyond the tags are kept."""

    def one(t: Column, g: Column) -> Column:
        base, cor = base_of(F.coalesce(g, F.lit(KEEP))), correction_of(F.coalesce(g, F.lit(KEEP)))
        return F.when(base == DELETE, F.array().cast("array<string>")).when((base == APPEND) & cor.isNotNull(), F.array(t, cor)).when(~base.isin(KEEP, APPEND), F.array(F.coalesce(cor, t))).otherwise(F.array(t))

    return F.array_join(F.flatten(F.zip_with(toks, F.slice(tags, 1, F.greatest(F.size(toks), F.lit(1))), one)), " ")


def mask(tag: Column, confidence: Column, threshold: float) -> Column:
    """Predictions below the threshold become keeps."""
    return F.when(confidence < threshold, KEEP).otherwise(tag)


def all_keep(tags: Column) -> Column:
    return F.forall(tags, lambda t: t == KEEP)


def collapse_rare(df: DataFrame, column: str = "tag", least: int = 5, weight: str | None = None) -> DataFrame:
    """Tags of fewer than `least` rows become their base ($REPLACE, $APPEND, $MORPH); others stay. Counts are joined, not windowed,
    so that a frequent tag is counted by partial sums. weight: a column with the number of rows that a row stands for."""
    counts = df.groupBy(column).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    tag = F.col(column)
    rare = F.when(tag.startswith(REPLACE), REPLACE).when(tag.startswith(APPEND), APPEND).when(tag.startswith(MORPH), MORPH).otherwise(tag)
    return df.join(counts, column, "left").withColumn(column, F.when(F.col("_n") < least, rare).otherwise(tag)).drop("_n")


def resolve(tags: DataFrame, vocab: DataFrame, column: str = "tag") -> DataFrame:
    """tags with `resolved`: the tag if the vocabulary (tag) has it, else its base if it has that, else $KEEP."""
    own, base = vocab.select(F.col("tag").alias(column), F.lit(True).alias("_own")).distinct(), vocab.select(F.col("tag").alias("_base"), F.lit(True).alias("_has")).distinct()
    out = tags.withColumn("_base", base_of(F.col(column))).join(own, column, "left").join(base, "_base", "left")
    return out.withColumn("resolved", F.when(F.col("_own"), F.col(column)).when(F.col("_has"), F.col("_base")).otherwise(KEEP)).drop("_base", "_own", "_has")


def class_weights(tags: DataFrame, vocab: DataFrame, weight: str | None = None) -> DataFrame:
    """tag, count, weight = sqrt(total / (tags * count)) for each tag of the vocabulary; an absent tag counts once. weight: as in
    collapse_rare()."""
    counts = resolve(tags, vocab).groupBy("resolved").agg((F.sum(weight) if weight else F.count("*")).alias("count"))
    totals = counts.agg(F.sum("count").alias("total")).crossJoin(vocab.agg(F.countDistinct("tag").alias("n")))  # one row
    out = vocab.select("tag").distinct().join(counts.withColumnRenamed("resolved", "tag"), "tag", "left").crossJoin(totals)
    count = F.coalesce("count", F.lit(1))
    return out.select("tag", count.alias("count"), F.sqrt(F.coalesce("total", F.lit(0)) / (F.col("n") * count)).alias("weight"))


def vocabulary(tags: DataFrame) -> DataFrame:
    """tag, id for the distinct tags, in order."""
    return tags.select("tag").distinct().withColumn("id", F.row_number().over(Window.orderBy("tag")) - 1)


def sample_clean(df: DataFrame, tags: str = "tags", order: str = "sent_id", keep: float = 0.1, seed: int = 42, counters: Counters | None = None) -> DataFrame:
    """df without most all-keep rows: one draw per such row, in row order, from a Mersenne twister (rows are kept where the draw
    does not exceed keep). order is a column of whole numbers, one a row.

    The ids of all-keep rows alone are ranked, once; a task starts its draws at the rank of its first row, so that the rows kept are those
    of one sequential pass, however the ids are dealt. counters: gets clean, and written and kept_clean when the result is computed.
    """
    clean = df.where(all_keep(F.col(tags))).select(F.col(order).cast("long").alias("_id"))
    ranked = numbered(clean, [F.col("_id")], "clean-ranks")

    def keepers(batches):
        rng, due = None, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, ranks = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            starts = np.flatnonzero(np.diff(ranks, prepend=due - 1) != 1)  # a task may read more than one stretch of ranks
            drawn = np.empty(len(ranks))
            for a, b in zip(np.append(0, starts[starts > 0]), np.append(starts[starts > 0], len(ranks))):
                if rng is None or ranks[a] != due:
                    rng = twister.generator(seed, int(ranks[a]))
                drawn[a:b] = [rng.random() for _ in range(b - a)]
                due = int(ranks[b - 1]) + 1 if b > a else due
            yield pa.RecordBatch.from_arrays([pa.array(ids[drawn <= keep], pa.int64())], ["_kept"])

    kept = ranked.select("_id", "rank").mapInArrow(keepers, "_kept long")
    out = df.where(~all_keep(F.col(tags))).unionByName(df.where(all_keep(F.col(tags))).join(kept, F.col(order).cast("long").eqNullSafe(F.col("_kept")), "left_semi"))
    if counters is not None:
        counters.put(clean=ranked._quillwork_rows)
        out = counters.observe(out, written=F.lit(1), kept_clean=all_keep(F.col(tags)))
    return out


def sequences_by_source(rows: DataFrame) -> DataFrame:
    """source, tokens, tags, target, dataset for rows (row_idx, source, target, dataset, start, end, tag): the edits of equal sources
    are laid on one tag array in the order of row_idx, later ones over earlier; target and dataset are those of the first row."""
    e = F.struct("row_idx", "start", "end", "tag")
    return sequences_by_text(rows.select("source", F.array(e).alias("e"), "row_idx", "target", "dataset"))


def sequences_by_text(texts: DataFrame) -> DataFrame:
    """sequences_by_source() of texts (source, e array<struct<row_idx,start,end,tag>>, row_idx, target, dataset), each with all its edits, so
    that a text is moved once and not with each of its edits. row_idx is that of its first edit."""
    by = texts.groupBy("source").agg(F.array_sort(F.flatten(F.collect_list("e"))).alias("e"), F.min_by("target", "row_idx").alias("target"), F.min_by("dataset", "row_idx").alias("dataset"))
    own = F.transform("e", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["tag"].alias("tag")))
    by = by.select("source", tokens(F.col("source")).alias("tokens"), own.alias("e"), "target", "dataset")
    return by.select("source", "tokens", edits_to_tags_a(F.col("tokens"), F.col("e")).alias("tags"), "target", "dataset")
