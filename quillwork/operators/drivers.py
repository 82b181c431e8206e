"""Whole chains: pairs to annotated blocks, blocks to blocks, blocks to token sequences, and the scoring report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions import text as X
from quillwork.functions.counters import Counters
from quillwork.functions.tables import written
from quillwork.sources import io

from . import reclass, score, tagger, tags
from .align import TOKEN, minimise, plain_tokens
from .typing_rules import typed_edits, with_type

#: words array<string> -> array<TOKEN>, or a trained tagger, which needs the table; plain_tokens is the annotation without any.
Annotator = Callable[[Column], Column] | tagger.Model


def _annotated(df: DataFrame, words: Column, out: str, annotate: Annotator) -> DataFrame:
    """df (sent_id, one a row) with out, the annotation of words. A tagger's is written, as each reader would tag anew."""
    if isinstance(annotate, tagger.Model):
        return written(tagger.annotated(annotate, df.withColumn("_words", words), "sent_id", "_words", out).drop("_words"), "annotated")
    return df.withColumn(out, annotate(words).cast(f"array<{TOKEN}>"))


def _edit(start, end, err_type, correction, coder) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), err_type.alias("err_type"), correction.alias("correction"), F.lit("REQUIRED").alias("required"), F.lit("-NONE-").alias("comment"), coder.cast("string").alias("coder"))


def _noop(coder) -> Column:
    return _edit(F.lit(-1), F.lit(-1), F.lit("noop"), F.lit("-NONE-"), coder)


def annotate_pairs(pairs: DataFrame, targets: list[str], annotate: Annotator = plain_tokens, word_list: DataFrame | None = None, merge: str = "rules", stem: Callable | None = None) -> DataFrame:
    """sent_id, source, tokens, edits: pairs (row_idx, source, and a column for each corrector) aligned and typed.

    A blank source is left out. Equal strings give a no-op; strings that differ in white space alone give a block without edits
    for that corrector. The source is annotated once for all correctors.
    """
    base = pairs.select(F.col("row_idx").alias("sent_id"), X.strip_space(F.col("source")).alias("source"), *targets).where("source <> ''")
    base = _annotated(base.withColumn("tokens", X.tokens(F.col("source"))), F.col("tokens"), "orig", annotate)
    found = None
    for k, t in enumerate(targets):
        text = X.strip_space(F.coalesce(F.col(t), F.lit("")))
        same = base.where(F.col("source") == text).select("sent_id", F.lit(k).alias("coder"), F.lit(0).alias("n"), _noop(F.lit(k)).alias("e"))
        diff = _annotated(base.where(F.col("source") != text), X.tokens(text), "cor", annotate).select("sent_id", "orig", "cor")
        e = typed_edits(diff, word_list, merge, stem)
        e = e.select("sent_id", F.lit(k).alias("coder"), (F.col("o_start") * 2 + F.when(F.col("o_end") > F.col("o_start"), 1).otherwise(0)).alias("n"), _edit(F.col("o_start"), F.col("o_end"), F.col("err_type"), F.col("correction"), F.lit(k)).alias("e"))
        both = same.unionByName(e)
        found = both if found is None else found.unionByName(both)
    by = found.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("coder", "n", "e"))).alias("a"))
    out = base.select("sent_id", "source", "tokens").join(by, "sent_id", "left")
    return out.select("sent_id", "source", "tokens", F.coalesce(F.transform("a", lambda x: x["e"]), F.array().cast(io.EDITS)).cast(io.EDITS).alias("edits"))


def reannotate(blocks: DataFrame, mode: str = "auto", annotate: Annotator = plain_tokens, word_list: DataFrame | None = None, old_cats: bool = False, merge: str = "rules") -> DataFrame:
    """Blocks with their edits made anew. auto: source and corrected sentence of each coder are aligned again. gold: the given edits
    are minimised and typed (Um becomes UNK), empty ones dropped; old_cats keeps the given types. No-ops stay."""
    per = io.per_coder(blocks)
    noop = per.where(F.forall("edits", lambda e: e["err_type"] == "noop")).select("sent_id", "coder", F.lit(0).alias("n"), _noop(F.col("coder")).alias("e"))
    rest = per.where(F.exists("edits", lambda e: e["err_type"] != "noop"))
    if mode == "auto":
        pair = rest.select(F.struct("sent_id", "coder").alias("sent_id"), "tokens", "corrected")
        pair = _annotated(_annotated(pair, F.col("tokens"), "orig", annotate), F.col("corrected"), "cor", annotate)
        e = typed_edits(pair, word_list, merge)
        made = e.select("sent_id.sent_id", "sent_id.coder", (F.col("o_start") * 2 + F.when(F.col("o_end") > F.col("o_start"), 1).otherwise(0)).alias("n"), _edit(F.col("o_start"), F.col("o_end"), F.col("err_type"), F.col("correction"), F.col("sent_id.coder")).alias("e"))
    elif mode == "gold":
        both = rest.select(F.struct("sent_id", "coder").alias("sent_id"), "tokens", "corrected", "edits")
        both = _annotated(_annotated(both, F.col("tokens"), "orig", annotate), F.col("corrected"), "cor", annotate)
        e = both.select("sent_id.*", "tokens", "orig", "cor", F.posexplode("edits").alias("n", "g")).where("g.err_type <> 'noop'")
        m = minimise(X.span(F.col("tokens"), F.col("g.start"), F.col("g.end")), X.tokens(F.col("g.correction")), F.col("g.start"), F.col("g.end"))
        e = e.withColumn("m", m)
        unsure = F.col("g.err_type") == "Um"
        start, end, cor = F.when(unsure, F.col("g.start")).otherwise(F.col("m.start")), F.when(unsure, F.col("g.end")).otherwise(F.col("m.end")), F.when(unsure, F.col("g.correction")).otherwise(F.col("m.cor"))
        c_start = F.col("g.c_start") + F.col("m.start") - F.col("g.start")
        e = with_type(e, "_type", F.col("orig"), F.col("cor"), start, end, c_start, c_start + F.size(X.tokens(cor)), F.lit(False))
        new = F.when(F.lit(old_cats), F.col("g.err_type")).when(unsure, "UNK").otherwise(F.col("_type"))
        e = e.where(unsure | (F.col("m.end") > F.col("m.start")) | (F.col("m.cor") != ""))
        made = e.select("sent_id", "coder", "n", _edit(start, end, new, cor, F.col("coder")).alias("e"))
    else:
        raise ValueError("mode is auto or gold")
    by = made.unionByName(noop).groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("coder", "n", "e"))).alias("a"))
    out = blocks.select("sent_id", "source", "tokens").join(by, "sent_id", "left")
    return out.select("sent_id", "source", "tokens", F.coalesce(F.transform("a", lambda x: x["e"]), F.array().cast(io.EDITS)).cast(io.EDITS).alias("edits"))


def pass_two_blocks(blocks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Blocks with R:OTHER edits decided by the lexicon; blocks without such an edit pass untouched."""
    has = F.exists("edits", lambda e: e["err_type"] == "R:OTHER")
    open_ = blocks.where(has)
    e = open_.select("sent_id", F.posexplode("edits").alias("n", "e"), "tokens").select("sent_id", "n", "e", X.span_text(F.col("tokens"), F.col("e.start"), F.col("e.end")).alias("orig"), F.col("e.correction").alias("correction"), F.col("e.err_type").alias("err_type"))
    new = reclass.pass_two(e, lexicon).groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("n", F.col("e").withField("err_type", F.col("err_type")).alias("e")))).alias("a"))
    done = open_.drop("edits").join(new, "sent_id").withColumn("edits", F.transform("a", lambda x: x["e"])).select(blocks.columns)
    return blocks.where(~has).unionByName(done)


def sequences(blocks: DataFrame, keep: float = 0.1, seed: int = 42, counters: Counters | None = None) -> DataFrame:
    """sent_id, tokens, tags, source, target of blocks, with most of the sentences without an edit left out by seeded draws. counters: see
    tags.sample_clean()."""
    out = blocks.select("sent_id", "tokens", tags.edits_to_tags(F.col("tokens"), F.col("edits")).alias("tags"), "source", tags.reconstruct_target(F.col("tokens"), F.col("edits")).alias("target"))
    return tags.sample_clean(out, keep=keep, seed=seed, counters=counters)


def training_table(pairs: DataFrame, lexicon: DataFrame, annotate: Annotator = plain_tokens, word_list: DataFrame | None = None, counters: Counters | None = None) -> DataFrame:
    """Pairs (row_idx, source, target) to token sequences: align, type, two passes of reclassification, tags. counters: those of
    sequences()."""
    blocks = reclass.pass_one_blocks(annotate_pairs(pairs, ["target"], annotate, word_list))
    return sequences(pass_two_blocks(blocks, lexicon), counters=counters)


def with_edits(rows: DataFrame, edits: DataFrame, on: str = "source") -> DataFrame:
    """rows, each with every edit of edits (start_tok, end_tok, err_type, correction) of its `on`: m rows and n edits of one value give
    m * n. A row without an edit is correct: (-1, -1), no correction; so is an edit's field that is null. Null values of `on` are one
    value. Columns of rows with the names of an edit's give way to them."""
    own = rows.drop("err_type", "correction", "start_tok", "end_tok")
    e = edits.select(F.col(on).alias("_on"), "start_tok", "end_tok", "err_type", "correction")
    out = own.join(e, F.col(on).eqNullSafe(F.col("_on")), "left").drop("_on")
    fill = {"start_tok": F.lit(-1), "end_tok": F.lit(-1), "err_type": F.lit("correct"), "correction": F.lit("")}
    return out.select(*own.columns, *[F.coalesce(F.col(c).cast("int") if c.endswith("_tok") else F.col(c), v).alias(c) for c, v in fill.items()])


def block_edits(blocks: DataFrame) -> DataFrame:
    """sent_id, coder, start, end, err_type, correction; a block without edits has a no-op of coder 0."""
    e = blocks.select("sent_id", F.explode_outer("edits").alias("e"))
    return e.select("sent_id", F.coalesce(F.col("e.coder").cast("int"), F.lit(0)).alias("coder"), F.coalesce("e.start", F.lit(-1)).alias("start"), F.coalesce("e.end", F.lit(-1)).alias("end"), F.coalesce("e.err_type", F.lit("noop")).alias("err_type"), F.coalesce("e.correction", F.lit("-NONE-")).alias("correction"))


def evaluate(hyp: DataFrame, ref: DataFrame, mode: str = "correction", beta: float = 0.5, multi: bool = False, level: int | None = None) -> DataFrame:
    """Scores of hypothesis blocks against reference blocks: one row, or one a category with level 1 to 3. Both must hold the same
    sentences. Only the hypothesis's coder 0 counts; of several reference coders the best is chosen sentence by sentence."""
    odd = hyp.select("sent_id").join(ref.select(F.col("sent_id").alias("other")), F.col("sent_id") == F.col("other"), "full_outer").where("sent_id is null or other is null")
    if odd.limit(1).count():
        raise ValueError("hypothesis and reference have different sentences")
    h = score.edit_keys(block_edits(hyp).where("coder = 0"), mode, multi)
    every = block_edits(ref)
    r = score.edit_keys(every, mode, multi)
    coders = every.select("sent_id", "coder").distinct()
    empty = coders.join(r.select("sent_id", "coder").distinct(), ["sent_id", "coder"], "left_anti").select("sent_id", "coder", F.lit("-1|-1").alias("key"), F.lit("noop").alias("cat"))
    counts = score.compare(h.drop("coder"), r.unionByName(empty))
    if coders.groupBy("sent_id").count().where("count > 1").limit(1).count():
        counts = counts.join(score.best_annotator(counts, coders.withColumn("place", F.col("coder")), beta), ["sent_id", "coder"], "left_semi")
    return score.total(counts, beta) if level is None else score.by_category(counts, level, beta)
