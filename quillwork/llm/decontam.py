"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, names and units become typed placeholders; windows of the canonical words of documents and benchmark items are
hash-joined; where enough of an item is met, its words are compared one by one, and a slot with another value counts only if the
slots are consistent. So re-parameterised questions are caught as well as verbatim ones. Windows of the words as they stand are
joined beside the canonical ones, so that case and layout don't hide a passage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, whole_row

#: Words in a window, and how many of a canonical one must be no slots.
PIECE, PLAIN = 4, 2
#: Share of an item's words in matched windows from which its words are compared; share of its words that must be met; share that
#: must be met by the same word; items of fewer words than SHORT must stand whole and as they are.
PROMISING, THRESHOLD, SAME, SHORT = 0.5, 0.8, 0.5, 8
#: Words by which a passage may be shifted by inserted or dropped words.
DRIFT = 8
#: Most benchmark windows to broadcast (some MB); beyond it they are shuffled and joined by sort and merge, with equal results.
BROADCAST_ROWS = 200_000
#: Units (fixed values); letters alone are no units.
UNITS = ("km", "cm", "mm", "kg", "mg", "ms", "kb", "mb", "gb", "hz", "khz", "mhz", "ghz", "lb", "oz", "ft", "mi", "mph", "kmh", "percent", "degrees", "meters", "metres", "kilometers", "kilometres", "miles", "feet", "inches", "grams", "kilograms", "pounds", "ounces", "liters", "litres", "seconds", "minutes", "hours", "days", "weeks", "months", "years", "dollars", "euros", "cents", "usd", "eur", "gbp")
_NUM, _NAME, _UNIT = "\ue000", "\ue001", "\ue002"
_WORD = r"\d+(?:[.,]\d+)*(?![\p{L}\p{N}])|[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """The words of text as they stand: numbers, and runs of letters and digits."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(_WORD), F.lit(0))


def canonical(word: Column) -> Column:
    """word lower-cased, or the placeholder of a number, a unit, or a capitalised word: a possible name, wherever it stands."""
    first = F.substring(word, 1, 1)
    return F.when(first.between("0", "9"), F.lit(_NUM)).when(F.lower(word).isin(*UNITS), F.lit(_UNIT)).when(F.lower(first) != first, F.lit(_NAME)).otherwise(F.lower(word))


def _is_slot(canon: Column) -> Column:
    return canon.between(_NUM, _UNIT)


def _keys(w: Column, window: Column) -> Column:
    """The hash of each window of the words w, in order."""
    starts = F.when(F.size(w) >= window, F.sequence(F.lit(1), F.size(w) - window + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, window)))


def found(docs: DataFrame, bench: DataFrame, threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, row_hash, item_id, start (word), coverage for documents with an item.

    Windows of PIECE words (an item with fewer is one window) are joined as lower-cased words and as canonical words, the latter
    only with PLAIN words that are no slots. Hits at offsets within DRIFT of each other count together. Where they hold PROMISING
    of an item's words, coverage is the share of its words that stand in the document at one of these offsets; a slot's word
    counts with another value if the slots are consistent: one value of the item always against one of the document, and one
    name of the document against one of the item (adjoining capitalised words being one name). Items without words match nothing. row_hash tells rows of one doc_id apart.
    """
    items = bench.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("iw")).where(F.size("iw") > 0).distinct()
    items = materialize(items.withColumn("n", F.size("iw")).withColumn("k", F.least("n", F.lit(PIECE))), "bench-items")

    def hashed(w: str) -> list[Column]:
        return [F.transform(w, lambda x: F.xxhash64(F.lower(x))).alias("lo"), F.transform(w, lambda x: F.xxhash64(canonical(x))).alias("ki")]

    both = items.select("item_id", "n", "k", "iw", *hashed("iw"))
    index = both.select("item_id", "n", "k", F.posexplode(_keys(F.col("lo"), F.col("k"))).alias("ipos", "key"))
    typed = both.select("item_id", "n", "k", "iw", F.posexplode(_keys(F.col("ki"), F.col("k"))).alias("ipos", "key"))
    plain = F.filter(F.slice("iw", F.col("ipos") + 1, F.col("k")), lambda x: ~_is_slot(canonical(x)))
    index = materialize(index.unionByName(typed.where((F.size(plain) >= PLAIN) & (F.col("n") >= SHORT)).drop("iw")).distinct(), "bench-windows")
    lengths = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most PIECE numbers
    small = index.count() <= broadcast_rows
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), words(F.col("text")).alias("w"))
    d = d.select("doc_id", "row_hash", *hashed("w"))
    hits = None
    for k in lengths:
        own = index.where(F.col("k") == k)
        starts = F.when(F.size("lo") >= k, F.sequence(F.lit(1), F.size("lo") - k + 1)).otherwise(F.array().cast("array<int>"))
        window = F.transform(starts, lambda i: F.struct(F.xxhash64(F.slice("lo", i, k)).alias("a"), F.xxhash64(F.slice("ki", i, k)).alias("b")))
        each = d.select("doc_id", "row_hash", F.posexplode(window).alias("pos", "x"))
        each = each.select("doc_id", "row_hash", "pos", F.explode(F.when(F.col("x.a") == F.col("x.b"), F.array("x.a")).otherwise(F.array("x.a", "x.b"))).alias("key"))
        each = each.join(F.broadcast(own) if small else own, "key").select("doc_id", "row_hash", "item_id", "n", "k", "ipos", (F.col("pos") - F.col("ipos")).alias("off"))
        hits = each if hits is None else hits.unionByName(each)
    if hits is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, row_hash long, item_id long, start int, coverage double")
    # offsets within DRIFT of each other share a band of one of two overlapping families
    bands = F.explode(F.array(F.struct(F.lit(0).alias("f"), F.floor(F.col("off") / (2 * DRIFT)).alias("b")), F.struct(F.lit(1).alias("f"), F.floor((F.col("off") + DRIFT) / (2 * DRIFT)).alias("b"))))
    hits = hits.select("*", bands.alias("band")).groupBy("doc_id", "row_hash", "item_id", "band").agg(F.max("n").alias("n"), F.max("k").alias("k"), F.sort_array(F.collect_set("off")).alias("offs"), F.collect_set("ipos").alias("at"))
    held = F.size(F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + F.col("k") - 1)))))
    hits = materialize(hits.where(held >= PROMISING * F.col("n")).select("doc_id", "row_hash", "item_id", "offs").distinct(), "bench-promising")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), F.col("text").cast("string").alias("text"))
    texts = texts.join(hits.select("doc_id", "row_hash").distinct(), (texts["doc_id"].eqNullSafe(hits["doc_id"])) & (texts["row_hash"] == hits["row_hash"]), "left_semi").dropDuplicates(["doc_id", "row_hash"])
    near = hits.alias("h").join(texts.alias("t"), F.expr("h.doc_id <=> t.doc_id and h.row_hash = t.row_hash")).select("h.*", words(F.col("t.text")).alias("w")).join(items.select("item_id", "iw", "n"), "item_id")
    # only the document's words at the item's place are kept; element p + o - first of them stands against the item's word p
    first = F.element_at("offs", 1)
    near = near.withColumn("start", first).withColumn("w", F.transform(F.sequence(F.lit(1), F.col("n") + F.element_at("offs", -1) - first), lambda p: F.when(p + first > 0, F.get("w", p + first - 1))))

    def against(p: Column) -> Column:
        mine = F.element_at("iw", p)
        other = F.transform("offs", lambda o: F.get("w", p + o - F.col("start") - 1))
        same = F.exists(other, lambda x: F.coalesce(F.lower(x) == F.lower(mine), F.lit(False)))
        slot = F.filter(other, lambda x: F.coalesce((canonical(x) == canonical(mine)) & _is_slot(canonical(mine)), F.lit(False)))
        # adjoining capitalised words are one name, called by its first word
        head = F.array_max(F.filter(F.sequence(F.lit(1), p), lambda j: ~((canonical(F.element_at("iw", j)) == _NAME) & (F.coalesce(canonical(F.get("iw", j - 2)), F.lit("")) == _NAME))))
        return F.struct(F.lower(mine).alias("item"), F.when(same, F.lower(mine)).when(F.size(slot) > 0, F.lower(F.get(slot, 0))).alias("doc"), canonical(mine).alias("kind"), F.lower(F.element_at("iw", head)).alias("name"))

    near = near.select("doc_id", "row_hash", "item_id", "start", "n", F.transform(F.sequence(F.lit(1), F.col("n")), against).alias("m"))
    same = F.size(F.filter("m", lambda x: F.coalesce(x["item"] == x["doc"], F.lit(False))))
    met = F.size(F.filter("m", lambda x: x["doc"].isNotNull()))
    # a capitalised word that stands as it is may be no name; numbers and units are slots with any value
    slots = F.array_distinct(F.filter("m", lambda x: x["doc"].isNotNull() & _is_slot(x["kind"]) & ((x["kind"] != _NAME) | (x["item"] != x["doc"]))))
    near = near.select("doc_id", "row_hash", "item_id", "start", "n", same.alias("same"), met.alias("met"), slots.alias("slots"))
    names = F.array_distinct(F.transform(F.filter("slots", lambda x: x["kind"] == _NAME), lambda x: F.struct(x["name"], x["doc"])))
    near = near.withColumn("names", names)
    consistent = (F.size(F.array_distinct(F.transform("slots", lambda x: x["item"]))) == F.size(F.array_distinct(F.transform("slots", lambda x: F.struct(x["item"], x["doc"]))))) & (F.size(F.array_distinct(F.transform("names", lambda x: x["doc"]))) == F.size("names"))
    templated = consistent & (F.col("n") >= SHORT) & (F.col("same") >= SAME * F.col("n"))
    near = near.select("doc_id", "row_hash", "item_id", "start", "n", (F.when(templated, F.col("met")).otherwise(F.col("same")) / F.col("n")).alias("coverage"))
    return near.where(F.col("coverage") >= F.when(F.col("n") < SHORT, 1.0).otherwise(threshold)).select("doc_id", "row_hash", "item_id", "start", "coverage")


def matches(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, row_hash, item_id, coverage (the highest) for documents with an item."""
    return found(docs, bench).groupBy("doc_id", "row_hash", "item_id").agg(F.max("coverage").alias("coverage"))


def decontaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, n_items (items found in the row's text), items (their ids, sorted), coverage (the highest, else 0), contaminated.

    A row for each row of docs. Null or empty texts are clean; a null doc_id is a value like others; repeated rows get equal
    results; very long texts are looked through whole; other columns of docs, whatever their names, aren't looked at; an empty
    benchmark leaves all clean; an empty documents table gives an empty result.
    """
    met = matches(docs, bench).groupBy("doc_id", "row_hash").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("coverage").alias("coverage"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"))
    joined = rows.alias("d").join(met.alias("f"), F.expr("d.doc_id <=> f.doc_id and d.row_hash = f.row_hash"), "left")
    items = F.coalesce("items", F.array().cast("array<bigint>"))
    return joined.select("d.doc_id", F.size(items).cast("long").alias("n_items"), F.array_join(items, ",").alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), (F.size(items) > 0).alias("contaminated"))


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of docs, whole and with columns of any names, in which no benchmark item was found; see decontaminated()."""
    bad = matches(docs, bench).select(F.col("doc_id").alias("bad_id"), F.col("row_hash").alias("bad_hash")).distinct()
    own = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_hash"))
    return own.join(bad, F.col("own_id").eqNullSafe(F.col("bad_id")) & (F.col("own_hash") == F.col("bad_hash")), "left_anti").select("row.*")
