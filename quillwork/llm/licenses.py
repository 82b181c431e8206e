"""License scans: phrase places, and an exact set-similarity join of text blocks with license templates.

DataFrame functions only. A block is a line, or a run of words about as long as a template wherever lines end (places()). A block meets a template when it has at least CONTAINMENT of the template's
distinct words, those that name the license among them, and none that names another. Words are ordered by their frequency over all blocks, the rarest first. A block with enough of a template's
words has one of the template's first n - needed + 1 words (prefix filter), has enough template words at all (length filter),
and has enough of them from the shared word's place on (positional filter); what passes is counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: What separates words: ASCII but digits and a-z (the text is lower-cased first).
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINMENT = 0.8
#: Words that may stand between those of a template in places().
SLACK = 6
#: Label and phrase, the base of every scan (fixed values).
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Label and template of the similarity join.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nd", "licensed under creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("proprietary", "all rights reserved no part of this work may be reproduced without permission"),
)
#: The words without which a template isn't met, however many of the others there are: those that name its license.
MUST = {
    "released under the mit license": ("mit",), "licensed under the apache license version 2 0": ("apache",), "this work is licensed under the gnu general public license version 3": ("gnu", "3"),
    "this work is licensed under the gnu general public license version 2": ("gnu", "2"), "licensed under the gnu lesser general public license": ("lesser",), "licensed under the gnu affero general public license version 3": ("affero",),
    "this source code form is subject to the terms of the mozilla public license v 2 0": ("mozilla",), "licensed under creative commons attribution 4 0 international license": ("attribution",),
    "licensed under creative commons attribution noncommercial 4 0 international license": ("noncommercial",), "licensed under creative commons attribution sharealike 4 0 international license": ("sharealike",),
    "licensed under creative commons attribution noderivatives 4 0 international license": ("noderivatives",), "licensed under cc by sa 4 0": ("sa",), "licensed under cc by nc 4 0": ("nc",), "dedicated to the public domain under cc0 1 0 universal": ("cc0",),
    "all rights reserved no part of this work may be reproduced without permission": ("reserved",),
}
#: The words beside which a template isn't met: they make its license another one.
BARRED = {
    "licensed under creative commons attribution 4 0 international license": ("noncommercial", "sharealike", "noderivatives"),
    "licensed under creative commons attribution noncommercial 4 0 international license": ("sharealike", "noderivatives"), "licensed under creative commons attribution sharealike 4 0 international license": ("noncommercial",),
    "licensed under creative commons attribution noderivatives 4 0 international license": ("noncommercial",),
}


def _lower(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _vocabulary() -> list[str]:
    return sorted({w for _, t in TEMPLATES for w in t.split()})


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash, block, words (the block's distinct template words) for each line that can meet some template.

    Words outside every template can't be shared with one, so a block is represented by its template words: the length filter
    on them is at least as strict as on all its words, and the positions needed are among them.
    """
    least = min(_needed(t) for _, t in TEMPLATES)
    line = F.posexplode(F.split(F.col("lowered"), "\n"))
    own = F.array_distinct(F.filter(F.split("line", _GAP), lambda w: w.isin(_vocabulary())))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), _lower(F.col("text")).alias("lowered"))
    return rows.select("doc_id", "row_hash", line.alias("block", "line")).select("doc_id", "row_hash", "block", own.alias("words")).where(F.size("words") >= least)


def _needed(template: str) -> int:
    n = len(set(template.split()))
    return -(-int(round(CONTAINMENT * n * 1000)) // 1000)


def places(docs: DataFrame, counted: dict[str, int]) -> DataFrame:
    """doc_id, row_hash, label, score for the labels whose template a run of words meets, whatever the lines.

    A run is SLACK words longer than the template; words that name another license bar it from SLACK words before to as many after it. One that meets it has one of the template's rarest n - needed + 1 words
    (by counted), so only the runs around these are looked at, and each is counted exactly. Its place goes from the first to the
    last of the template's words; a template goes where half of its place or more lies in that of a label contained more.
    """
    index = []
    for k, (label, template) in enumerate(TEMPLATES):
        own, needed = sorted(set(template.split()), key=lambda w: (counted.get(w, 0), w)), _needed(template)
        index += [(word, k, label, own, needed, len(template.split()) + SLACK, list(MUST.get(template, ())), list(BARRED.get(template, ()))) for word in own[: len(own) - needed + 1]]
    most = max(x[5] for x in index)
    spark = docs.sparkSession
    prefix = F.broadcast(spark.createDataFrame(index, "word string, template int, label string, own array<string>, needed int, run int, must array<string>, barred array<string>"))  # at most a row a word of TEMPLATES
    rare = sorted({x[0] for x in index})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), F.split(_lower(F.col("text")), _GAP).alias("w"))
    rows = rows.withColumn("at", F.filter(F.transform("w", lambda x, i: F.when(x.isin(rare), i)), lambda i: i.isNotNull())).where(F.size("at") > 0)
    # the words from `low` (0-based) on, at most `most` on each side of a rare one
    around = F.transform("at", lambda i: F.struct(i.alias("i"), F.greatest(i - most, F.lit(0)).alias("low"), F.get("w", i).alias("word"), F.slice("w", F.greatest(i - most, F.lit(0)) + 1, 2 * most + 1).alias("seg")))
    near = rows.select("doc_id", "row_hash", F.explode(around).alias("x")).select("doc_id", "row_hash", "x.*").join(prefix, "word")
    near = near.where(F.size(F.array_intersect("seg", "own")) >= F.col("needed"))
    starts = F.sequence(F.greatest(F.col("i") - F.col("run") + 1, F.lit(0)), F.col("i"))

    def counted_run(s: Column) -> Column:
        run = F.slice("seg", s - F.col("low") + 1, F.col("run"))
        about = F.slice("seg", F.greatest(s - F.col("low") - SLACK, F.lit(0)) + 1, F.col("run") + 2 * SLACK)
        named = (F.size(F.array_except("must", run)) == 0) & ~F.arrays_overlap("barred", about)
        return F.struct(F.when(named, F.size(F.array_intersect(run, F.col("own")))).otherwise(0).alias("n"), (-s).alias("s"))

    runs = F.transform(starts, counted_run)
    near = near.withColumn("best", F.array_max(runs)).where(F.col("best.n") >= F.col("needed"))
    first = -F.col("best.s")
    inside = F.filter(F.sequence(F.lit(0), F.col("run") - 1), lambda j: F.coalesce(F.array_contains("own", F.get("seg", first - F.col("low") + j)), F.lit(False)))
    near = near.select("doc_id", "row_hash", "label", "template", (F.col("best.n") / F.size("own")).alias("score"), first.alias("first"), inside.alias("inside"))
    near = materialize(near.select("doc_id", "row_hash", "label", "template", "score", (F.col("first") + F.array_min("inside")).alias("low"), (F.col("first") + F.array_max("inside")).alias("high")).distinct(), "license-places")
    shared = F.least("p.high", "q.high") - F.greatest("p.low", "q.low") + 1
    within = F.expr("p.doc_id <=> q.doc_id and p.row_hash = q.row_hash and p.label <> q.label and q.score > p.score") & (2 * shared >= F.col("p.high") - F.col("p.low") + 1)
    return near.alias("p").join(near.alias("q"), within, "left_anti").groupBy("doc_id", "row_hash", "label").agg(F.max("score").alias("score"))


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash, label, score for the pairs of a row of docs and a label of which a block meets a template.

    All meeting pairs of block and template are found; a line is named after the templates it contains most of, so that a
    version or a clause decides between licenses alike, and after those that places() finds anywhere. score is the highest
    containment, CONTAINMENT to 1.
    """
    table = materialize(blocks(docs), "license-blocks")
    # frequencies of the template words over all blocks; a row for each word of TEMPLATES at most
    counted = {r[0]: r[1] for r in table.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*")).collect()}
    order = {w: k for k, w in enumerate(sorted(_vocabulary(), key=lambda w: (counted.get(w, 0), w)))}
    index, whole = [], []
    for k, (label, template) in enumerate(TEMPLATES):
        ranks, needed = sorted({order[w] for w in template.split()}), _needed(template)
        index += [(r, k, p, len(ranks), needed) for p, r in enumerate(ranks[: len(ranks) - needed + 1])]
        whole.append((k, label, ranks, needed, [order[w] for w in MUST.get(template, ())], [order[w] for w in BARRED.get(template, ())]))
    spark = docs.sparkSession
    prefix = F.broadcast(spark.createDataFrame(index, "rank int, template int, tpos int, n int, needed int"))  # at most a row a word of TEMPLATES
    templates = F.broadcast(spark.createDataFrame(whole, "template int, label string, ranks array<int>, needed int, must array<int>, barred array<int>"))
    rank = F.create_map(*[F.lit(x) for w, r in order.items() for x in (w, r)])
    ranked = table.select("doc_id", "row_hash", "block", F.array_sort(F.transform("words", lambda w: F.element_at(rank, w))).alias("b"))
    each = ranked.select("doc_id", "row_hash", "block", "b", F.posexplode("b").alias("bpos", "rank"))
    left = F.least(F.col("n") - F.col("tpos"), F.size("b") - F.col("bpos"))  # from the shared word on, that one included
    found = each.join(prefix, "rank").where((F.size("b") >= F.col("needed")) & (left + F.least("tpos", "bpos") >= F.col("needed")))
    found = found.select("doc_id", "row_hash", "block", "b", "template").distinct().join(templates, "template")
    common = F.size(F.array_intersect("b", "ranks"))
    named = (F.size(F.array_except("must", "b")) == 0) & ~F.arrays_overlap("barred", "b")
    met = found.where((common >= F.col("needed")) & named).select("doc_id", "row_hash", "block", "label", (common / F.size("ranks")).alias("score"))
    of_block = met.groupBy("doc_id", "row_hash", "block").agg(F.max("score").alias("score"), F.collect_set(F.struct("label", "score")).alias("all"))
    best = of_block.select("doc_id", "row_hash", "score", F.explode(F.filter("all", lambda x: x["score"] == F.col("score"))["label"]).alias("label"))
    return best.unionByName(places(docs, counted)).groupBy("doc_id", "row_hash", "label").agg(F.max("score").alias("score"))


def _stands(phrase: str):
    """Whether the phrase's words stand in the array w from the place i on."""

    def at(i: Column) -> Column:
        hit = F.lit(True)
        for k, word in enumerate(phrase.split()):
            hit = hit & F.coalesce(F.try_element_at("w", i + k) == word, F.lit(False))
        return hit

    return at


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs.

    Base: places where a phrase of PHRASES stands word by word. labels adds those of similar(). score is 1 with a base label,
    else the highest containment, else 0. Null texts are empty; rows are judged by their texts, so repeated rows, equal
    scores and null ids change nothing; an empty table gives an empty result.
    """
    lowered = _lower(F.col("text"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), F.concat(F.lit(" "), F.btrim(F.regexp_replace(lowered, _GAP, " "), F.lit(" ")), F.lit(" ")).alias("t"))
    has = F.lit(False)
    for _, phrase in PHRASES:
        has = has | F.contains("t", F.lit(f" {phrase} "))
    n = F.when(F.col("t") == "  ", 0).otherwise(F.length("t") - F.length(F.translate("t", " ", "")) - 1).cast("long")
    w = F.split(F.btrim("t"), " ")
    places = [F.filter(F.sequence(F.lit(1), F.size("w")), _stands(phrase)) for _, phrase in PHRASES]
    labels = [F.when(F.contains("t", F.lit(f" {phrase} ")), F.lit(label)) for label, phrase in PHRASES]
    base = base.select("doc_id", "row_hash", "t", n.alias("n_words"), F.when(has, w).alias("w"))
    all_places = F.when(F.col("w").isNotNull(), F.flatten(F.array(*places))).otherwise(F.array().cast("array<int>"))
    base = base.select("doc_id", "row_hash", "n_words", all_places.alias("p"), F.sort_array(F.array_distinct(F.array_compact(F.array(*labels)))).alias("bl"))
    near = similar(docs).groupBy("doc_id", "row_hash").agg(F.collect_set("label").alias("nl"), F.max("score").alias("s"))
    out = base.alias("d").join(near.alias("n"), F.expr("d.doc_id <=> n.doc_id and d.row_hash = n.row_hash"), "left")
    every = F.array_sort(F.array_union("bl", F.coalesce("nl", F.array().cast("array<string>"))))
    return out.select(
        "d.doc_id", "n_words", F.size("p").cast("long").alias("n_base"), (F.array_min("p") - 1).cast("long").alias("first_word"), (F.array_max("p") - 1).cast("long").alias("last_word"),
        F.array_join("bl", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.when(F.size("p") > 0, 1.0).otherwise(F.coalesce("s", F.lit(0.0))).alias("score"),
    )
