"""Scoring of predicted against reference edits: keys, true and false counts, precision, recall and F-beta."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.tables import forget, numbered, written
from quillwork.functions.text import let, tokens

MODES = ("token", "span", "correction", "correction_type")


def edit_keys(edits: DataFrame, mode: str = "correction", multi: bool = False) -> DataFrame:
    """sent_id, coder, key, cat: a row for each edit, and in token mode for each token it covers.

    edits: sent_id, coder, start, end, err_type, correction. Edits of type UNK count in the detection modes only; multi keeps
    edits of two or more words on a side. In token mode an insertion belongs to the token on its right.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    df = edits
    if mode in ("correction", "correction_type"):
        df = df.where("err_type <> 'UNK'")
    if multi:
        df = df.where((F.col("end") - F.col("start") >= 2) | (F.size(tokens(F.col("correction"))) >= 2))
    if mode == "token":
        df = df.withColumn("_t", F.explode(_covered(F.col)))
    return df.select("sent_id", "coder", _key(F.col, mode, F.col("_t") if mode == "token" else None).alias("key"), F.col("err_type").alias("cat"))


def _covered(of) -> Column:
    """The tokens of an edit, of(name) being its fields."""
    start, end = of("start"), of("end")
    return F.when(start == -1, F.array(start)).when(start == end, F.array(start)).when(end > start, F.sequence(start, end - 1)).otherwise(F.array().cast("array<int>"))


def _key(of, mode: str, t: Column | None = None) -> Column:
    """What an edit is compared by, of(name) being its fields; in token mode, for its token t."""
    if mode == "token":
        return F.concat_ws("|", t, F.when(of("start") == -1, t).otherwise(t + 1))
    return F.concat_ws("|", *[of(c) for c in {"span": ("start", "end"), "correction": ("start", "end", "correction"), "correction_type": ("start", "end", "err_type", "correction")}[mode]])


def compare(hyp: DataFrame, ref: DataFrame) -> DataFrame:
    """sent_id, coder, cat, tp, fp, fn by reference coder and category: a full outer join on the key.

    hyp: sent_id, key, cat; ref: sent_id, coder, key, cat. Where both have a key, each of the reference's categories at it is a
    true positive, otherwise each own one a false positive or negative. No-op edits count for nothing by themselves.
    """
    h = hyp.groupBy("sent_id", "key").agg(F.collect_list("cat").alias("hc"))
    r = ref.groupBy("sent_id", "coder", "key").agg(F.collect_list("cat").alias("rc"))
    coders = ref.select("sent_id", "coder").distinct()
    coder = F.lit(0).cast(dict(ref.dtypes)["coder"])  # a sentence without a reference edit has coder 0
    h = h.join(coders, "sent_id", "left").withColumn("coder", F.coalesce("coder", coder))
    j = h.join(r, ["sent_id", "coder", "key"], "full_outer")
    noop_h, noop_r = F.coalesce(F.get("hc", 0) == "noop", F.lit(False)), F.coalesce(F.get("rc", 0) == "noop", F.lit(False))  # empty if the type is null
    kind = F.when(F.col("hc").isNotNull() & F.col("rc").isNotNull() & ~noop_h, "tp").when(F.col("rc").isNull() & ~noop_h, "fp").when(F.col("hc").isNull() & ~noop_r, "fn")
    j = j.withColumn("kind", kind).where("kind is not null").select("sent_id", "coder", "kind", F.explode(F.when(F.col("kind") == "fp", F.col("hc")).otherwise(F.col("rc"))).alias("cat"))
    return j.groupBy("sent_id", "coder", "cat").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")])


_KEYS = "array<struct<key:string,cat:string>>"


def _array_keys(edits: Column, mode: str) -> Column:
    """edit_keys() of an array of edits, as an array of (key, cat)."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if mode in ("correction", "correction_type"):
        edits = F.filter(edits, lambda x: x["err_type"] != "UNK")
    pair = lambda x, t=None: F.struct(_key(x.__getitem__, mode, t).alias("key"), x["err_type"].alias("cat"))
    if mode == "token":
        found = F.flatten(F.transform(edits, lambda x: F.transform(_covered(x.__getitem__), lambda t: pair(x, t))))
    else:
        found = F.transform(edits, lambda x: pair(x))
    return F.coalesce(found.cast(_KEYS), F.array().cast(_KEYS))


def _array_counts(x: Column) -> Column:
    """array<(cat, tp, fp, fn)> of a sentence's keys, struct<h,r>, by hashed sets of keys; null if a key repeats on a side."""
    h, r = x["h"], x["r"]
    noop = lambda c: F.coalesce(c == "noop", F.lit(False))
    none, size = F.lit(0).cast("long"), lambda a: F.size(a).cast("long")

    def each(k: Column) -> Column:
        def one(c: Column) -> Column:
            own = F.struct(*[F.filter(k[s], lambda y: y["cat"].eqNullSafe(c))["key"].alias(s) for s in ("h", "r")])
            return let(own, lambda o: F.struct(
                c.alias("cat"), size(F.array_intersect(o["r"], k["real"])).alias("tp"), F.when(noop(c), none).otherwise(size(F.array_except(o["h"], k["r"]["key"]))).alias("fp"),
                F.when(noop(c), none).otherwise(size(F.array_except(o["r"], k["h"]["key"]))).alias("fn"),
            ))

        once = (F.size(F.array_distinct(k["h"]["key"])) == F.size(k["h"])) & (F.size(F.array_distinct(k["r"]["key"])) == F.size(k["r"]))
        return F.when(once, F.transform(F.array_compact(F.array_distinct(F.concat(k["h"]["cat"], k["r"]["cat"]))), one))

    return let(F.struct(h.alias("h"), r.alias("r"), F.filter(h, lambda y: ~noop(y["cat"]))["key"].alias("real")), each)


def array_compare(df: DataFrame, mode: str = "correction") -> DataFrame:
    """compare() of sentences that are a row each, with arrays of edits and one reference coder, 0: no edit is moved, joined or sorted, so
    that a task holds a row at a time and what is shuffled are counts.

    df: sent_id, hyp, ref (array<struct<start,end,err_type,correction>>). Rows that share a sent_id or have none, and sentences with two
    edits of one key on a side, go through compare().
    """
    keys = F.struct(_array_keys(F.col("hyp"), mode).alias("h"), _array_keys(F.col("ref"), mode).alias("r"))
    counts = written(df.select("sent_id", let(keys, _array_counts).alias("n")), "sentence-counts")
    odd = counts.groupBy("sent_id").agg(F.count("*").alias("_rows"), F.count("n").alias("_n")).where((F.col("_rows") > 1) | (F.col("_n") == 0) | F.col("sent_id").isNull())
    odd, own, parts = odd.select(F.col("sent_id").alias("_odd")), counts, []
    if odd.limit(1).count():
        odd = written(odd, "odd-sentences")
        among = F.col("sent_id").eqNullSafe(F.col("_odd"))
        own, rest = counts.join(odd, among, "left_anti"), written(df.join(odd, among, "left_semi"), "odd-edits")
        hyp, ref = (edit_keys(rest.select("sent_id", F.lit(0).alias("coder"), F.inline(side)), mode) for side in ("hyp", "ref"))
        parts.append(compare(hyp.drop("coder"), ref))
    own = own.select("sent_id", F.lit(0).alias("coder"), F.inline("n")).where("tp + fp + fn > 0")
    return own.unionByName(parts[0]) if parts else own


def precision(tp: Column, fp: Column) -> Column:
    return F.when(fp > 0, tp / (tp + fp)).otherwise(F.lit(1.0))


def f_beta(tp: Column, fp: Column, fn: Column, beta: float = 0.5) -> Column:
    p, r = precision(tp, fp), precision(tp, fn)
    return F.when(p + r > 0, F.lit(1 + beta**2) * p * r / (F.lit(beta**2) * p + r)).otherwise(F.lit(0.0))


def with_scores(counts: DataFrame, beta: float = 0.5) -> DataFrame:
    """counts with p, r, f to four places: p is 1 without false positives, r without false negatives, even if nothing was found."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumn("p", F.round(precision(tp, fp), 4)).withColumn("r", F.round(precision(tp, fn), 4)).withColumn("f", F.round(f_beta(tp, fp, fn, beta), 4))


def by_category(counts: DataFrame, level: int = 3, beta: float = 0.5, only_reference: bool = True) -> DataFrame:
    """cat, tp, fp, fn, p, r, f. level 1: operation, 2: category without it, 3: both; UNK stays. Categories that the reference
    never has are left out."""
    cat = F.col("cat")
    rolled = {1: F.when(cat == "UNK", cat).otherwise(F.substring(cat, 1, 1)), 2: F.when(cat == "UNK", cat).otherwise(F.substr(cat, F.lit(3))), 3: cat}[level]
    out = counts.groupBy(rolled.alias("cat")).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return with_scores(out.where("tp + fn > 0") if only_reference else out, beta)


def rollup(counts: DataFrame, beta: float = 0.5) -> DataFrame:
    """Operation, operation and category, and total in one pass (GROUPING SETS): op, cat (null where rolled up), counts and scores."""
    df = counts.withColumn("op", F.substring("cat", 1, 1)).groupingSets([["op", "cat"], ["op"], []], "op", "cat").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return with_scores(df, beta)


def total(counts: DataFrame, beta: float = 0.5) -> DataFrame:
    out = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    return with_scores(out, beta)


#: Sentences folded by one task at a time.
FOLD = 4096


def _f_score(tp: int, fp: int, fn: int, beta: float) -> float:
    p = tp / (tp + fp) if fp else 1.0
    r = tp / (tp + fn) if fn else 1.0
    return round((1 + beta**2) * p * r / (beta**2 * p + r), 4) if p + r else 0.0


def _fold(beta: float):
    """The choices of one piece, sentence by sentence, on top of the totals (tp, fp, fn) that hold before it."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["rank", "place"])
        now = [int(pdf[f"_{c}"].iloc[0]) for c in ("tp", "fp", "fn")] if len(pdf) else []
        chosen, at, rows = [], None, list(pdf[["rank", "sent_id", "coder", "tp", "fp", "fn"]].itertuples(index=False, name=None))
        best = None
        for rank, sent, coder, *own in [*rows, (None, None, None, 0, 0, 0)]:
            if rank != at:
                if best is not None:
                    now = [a + b for a, b in zip(now, best[2:])]
                    chosen.append((pdf["piece"].iloc[0], *best[:2], *best[2:]))
                at, best, top = rank, None, None
            if rank is not None:
                key = (_f_score(*[a + b for a, b in zip(now, own)], beta), own[0], -own[1], -own[2])
                if top is None or key > top:
                    top, best = key, (sent, coder, *own)
        return pd.DataFrame(chosen, columns=["piece", "sent_id", "coder", "tp", "fp", "fn"])

    return run


def best_annotator(counts: DataFrame, sentences: DataFrame, beta: float = 0.5, fold: int = FOLD) -> DataFrame:
    """sent_id, coder: the reference coder chosen for each sentence, in the order of sent_id (a whole number).

    The choice maximises F over the running totals (ties: more tp, fewer fp, fewer fn, the coder that comes first), so a sentence's
    choice hangs on all before it. The fold is speculative: sentences are cut into pieces of `fold`, each piece is folded by a task of its
    own from the totals that the last round left before it, and pieces whose totals come out otherwise are folded again, until none
    is. The first piece that isn't final becomes so in each round, so that the end is that of one sequential fold; as totals grow, choices
    hang less and less on them, and few rounds suffice. sentences: sent_id, coder, place (order of coders within the sentence).
    """
    of = ("tp", "fp", "fn")
    sums = counts.groupBy("sent_id", "coder").agg(*[F.sum(c).alias(c) for c in of])
    rows = sentences.join(sums, ["sent_id", "coder"], "left").na.fill(0, of)
    order = numbered(sentences.select("sent_id").distinct(), [F.col("sent_id")], "fold-ranks")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    rows = rows.join(order, "sent_id").select(F.floor(F.col("rank") / fold).alias("piece"), "rank", "sent_id", "coder", "place", *[F.col(c).cast("long").alias(c) for c in of])
    rows = written(rows, "fold-rows")
    shape = f"piece long, sent_id {kind['sent_id']}, coder {kind['coder']}, tp long, fp long, fn long"
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # a row a piece

    def starts(chosen: DataFrame) -> DataFrame:
        total = chosen.groupBy("piece").agg(*[F.sum(c).alias(c) for c in of])
        return written(total.select("piece", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in of]), "fold-starts")

    first = rows.groupBy("piece", "sent_id").agg(F.min_by(F.struct(*of), "place").alias("c")).select("piece", "c.*")
    now, picked = starts(first), None
    again = now
    while True:
        folded = rows.join(again, "piece").groupBy("piece").applyInPandas(_fold(beta), shape)
        then = written(folded if picked is None else picked.join(again, "piece", "left_anti").unionByName(folded), "fold-picks")
        totals = starts(then)
        again = totals.join(now, ["piece", *[f"_{c}" for c in of]], "left_anti")
        if picked is not None:
            forget(picked)
        picked, now = then, totals
        if not again.limit(1).count():
            return picked.select("sent_id", "coder")


def binary_scores(df: DataFrame, gold: Column, pred: Column, beta: float = 0.5) -> DataFrame:
    """tp, fp, fn, p, r, f of a binary prediction (0 where undefined)."""
    out = df.agg(F.count_if(gold & pred).alias("tp"), F.count_if(~gold & pred).alias("fp"), F.count_if(gold & ~pred).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    return out.withColumn("p", p).withColumn("r", r).withColumn("f", F.when(p + r > 0, F.lit(1 + beta**2) * p * r / (F.lit(beta**2) * p + r)).otherwise(F.lit(0.0)))


def class_f_beta(df: DataFrame, gold: str, pred: str, classes: list[str], base: callable = None, exact_only: bool = False, beta: float = 0.5) -> DataFrame:
    """class, tp, fp, fn, p, r, f. exact_only counts a prediction only where it equals the gold tag (then there are no false positives)."""
    base = base or (lambda c: c)
    of = df.select(base(F.col(gold)).alias("g"), base(F.col(pred)).alias("p"), (F.col(gold) == F.col(pred)).alias("same"))
    each = of.withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes])))
    g = F.col("g") == F.col("class")
    p = g & F.col("same") if exact_only else F.col("p") == F.col("class")
    out = each.groupBy("class").agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    pr = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    re = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    return out.withColumn("prec", pr).withColumn("rec", re).withColumn("f", F.when(pr + re > 0, F.lit(1 + beta**2) * pr * re / (F.lit(beta**2) * pr + re)).otherwise(F.lit(0.0)))


def runs(df: DataFrame, seq: str, pos: str, tag: str) -> DataFrame:
    """seq, start, end, tag: maximal runs of equal tags (gaps and islands); sequences are partitions, so a long one is one task's."""
    w = Window.partitionBy(seq).orderBy(pos)
    new = F.when(F.lag(tag).over(w).eqNullSafe(F.col(tag)), 0).otherwise(1)
    marked = df.withColumn("_g", new).withColumn("_g", F.sum("_g").over(w))
    return marked.groupBy(seq, "_g", tag).agg(F.min(pos).alias("start"), F.max(pos).alias("end")).drop("_g")


def sequence_run_f1(df: DataFrame, seq: str, pos: str, gold: str, pred: str) -> DataFrame:
    """tp, n_gold, n_pred, p, r, f1 over runs of equal tags that agree in place and tag."""
    return _run_scores(_run_counts(df, seq, pos, gold, pred))


def _run_counts(df: DataFrame, seq: str, pos: str, gold: str, pred: str) -> DataFrame:
    g, p = runs(df, seq, pos, gold).withColumnRenamed(gold, "tag"), runs(df, seq, pos, pred).withColumnRenamed(pred, "tag")
    j = g.withColumn("g", F.lit(1)).join(p.withColumn("p", F.lit(1)), [seq, "start", "end", "tag"], "full_outer")
    return j.agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count("g").alias("n_gold"), F.count("p").alias("n_pred"))


def _run_scores(out: DataFrame) -> DataFrame:
    pr, re = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0)), F.when(F.col("n_gold") > 0, F.col("tp") / F.col("n_gold")).otherwise(F.lit(0.0))
    return out.withColumn("p", pr).withColumn("r", re).withColumn("f1", F.when(pr + re > 0, 2 * pr * re / (pr + re)).otherwise(F.lit(0.0)))


def _array_runs(gold: Column, pred: Column) -> Column:
    """struct<tp,n_gold,n_pred> of two arrays of tags of one length: a run of both starts where both change to an equal tag, and is the same
    one if the next change is one of both, or the end."""

    def changes(x: Column) -> Column:
        g, p = x["g"], x["p"]
        new = lambda c, i, bit: F.when((i == 0) | ~F.get(c, i).eqNullSafe(F.get(c, i - 1)), bit).otherwise(0)
        codes = F.transform(g, lambda t, i: new(g, i, 1) + new(p, i, 2) + F.when(t == F.get(p, i), 4).otherwise(0))
        return F.filter(codes, lambda c: c.bitwiseAND(3) > 0)

    def counts(c: Column) -> Column:
        same = F.filter(c, lambda x, i: (x == 7) & (F.coalesce(F.get(c, i + 1), F.lit(3)).bitwiseAND(3) == 3))
        return F.struct(F.size(same).alias("tp"), F.size(F.filter(c, lambda x: x.bitwiseAND(1) > 0)).alias("n_gold"), F.size(F.filter(c, lambda x: x.bitwiseAND(2) > 0)).alias("n_pred"))

    return let(let(F.struct(gold.alias("g"), pred.alias("p")), changes), counts)


def array_run_f1(df: DataFrame, seq: str, gold: str, pred: str) -> DataFrame:
    """sequence_run_f1() of sequences that are a row each, with arrays of tags of one length: no word is moved or sorted, so that a task
    holds a row at a time. Rows of one seq, or without one, are a sequence as they are there."""
    of = ("tp", "n_gold", "n_pred")
    more = df.groupBy(seq).agg(F.count("*").alias("_n")).where((F.col("_n") > 1) | F.col(seq).isNull()).select(F.col(seq).alias("_seq"))
    own, parts = df, []
    if more.limit(1).count():
        more = written(more, "run-seqs")
        own = df.join(more, F.col(seq).eqNullSafe(F.col("_seq")), "left_anti")
        both = df.join(more, F.col(seq).eqNullSafe(F.col("_seq")), "left_semi").select(seq, F.posexplode(F.arrays_zip(F.col(gold).alias("gold"), F.col(pred).alias("pred"))).alias("pos", "x"))
        parts.append(_run_counts(both.select(seq, "pos", "x.gold", "x.pred"), seq, "pos", "gold", "pred"))
    parts.append(own.select(_array_runs(F.col(gold), F.col(pred)).alias("c")).agg(*[F.coalesce(F.sum(f"c.{c}"), F.lit(0)).alias(c) for c in of]))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return _run_scores(every.agg(*[F.sum(c).alias(c) for c in of]))
