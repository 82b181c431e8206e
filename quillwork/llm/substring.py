"""Substring deduplication by relative Lempel-Ziv factors of at least 50 words.

Every document is parsed, left to right and greedily, against the reference: all documents with a smaller doc_id. Where the 50
words at the cursor stand in the reference, a copy factor begins (reference document, place, length) and goes on while the
following words follow there too; then the cursor moves behind it. Other words are literals. Copies and literals give the words
back. A window that straddles the end of a factor may stand in the reference too, so those at every boundary are looked up as well;
what they and the factors cover are the duplicate spans.

The reference is indexed by blocks: each window is filed under its minimiser, the least hash of its 35 sixteen-word grams, which
depends on the window's words only, so equal windows meet under equal anchors. Anchors of one document alone can't bear a factor,
and full windows are hashed and joined, once for each document they stand in, only where an anchor is shared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tokens, in_arrow_batches, materialize, mix64, small_batches, trimmed, window_hash

WINDOW, GRAM = 50, 16
_SLICE = 1 << 19
_FACTOR = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref", pa.int64()), ("ref_start", pa.int32())])
_SPAN = pa.struct([("start", pa.int32()), ("length", pa.int32())])


def _anchors(t: Tokens, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place where a window could start in the batch: whether it lies in one document, and its anchor."""
    words, span = t.hash, window - gram + 1
    if len(words) < window:
        return np.zeros(0, bool), np.zeros(0, np.uint64)
    least, width = mix64(window_hash(words, gram, 1)), 1
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    return t.doc[: len(least)] == t.doc[window - 1 :], least


def _profile(window: int, gram: int):
    def run(batches):
        for whole in batches:
            for batch in in_arrow_batches(whole, _SLICE):
                t = Tokens(batch.column(1))
                inside, anchor = _anchors(t, window, gram)
                doc, anchor = t.doc[: len(inside)][inside], anchor[inside]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
                doc, anchor = doc[new], anchor[new]
                texts = [(x or "").encode().split() for x in batch.column(1).to_pylist()]
                sha = [hashlib.sha256(b" ".join(w)).hexdigest() for w in texts]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(t.n + 1)).astype(np.int32)), pa.array(anchor.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(t.first).astype(np.int64)), pa.array(sha), lists], ["doc_id", "k", "n_words", "sha", "anchors"])

    return run


def _window_hashes(t: Tokens, window: int) -> tuple[np.ndarray, np.ndarray]:
    return window_hash(t.hash, window), window_hash(t.hash, window, 7) & np.uint64(0x7FFFFFFF)


def _windows(window: int, gram: int):
    """Each distinct window of a document under its live anchors: its hashes, the document, and where it first stands there."""

    def run(batches):
        for whole in batches:
            for batch in in_arrow_batches(whole, _SLICE):
                t = Tokens(batch.column(1))
                inside, anchor = _anchors(t, window, gram)
                live = batch.column(3).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                at = np.flatnonzero(inside & np.isin(anchor, live))
                if not len(at):
                    continue
                h, g = _window_hashes(t, window)
                at = at[_first_of(t.doc[at], h[at])]
                ids, k = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                for part in np.array_split(at, -(-len(at) // 100_000)):
                    d = t.doc[part]
                    place = (part - t.first[d]).astype(np.int64) << 32 | k[d]
                    yield pa.RecordBatch.from_arrays([pa.array(h[part].view(np.int64)), pa.array(g[part].astype(np.int32)), pa.array(ids[d]), pa.array(place)], ["h", "g", "doc_id", "place"])

    return run


def _first_of(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where each pair of doc and h stands first."""
    order = np.lexsort((h, doc))  # stable: equal pairs stay in order
    new = np.ones(len(order), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (h[order][1:] != h[order][:-1])
    return np.sort(order[new])


def parse(n: int, hit: np.ndarray, ref: np.ndarray, ref_start: np.ndarray, window: int = WINDOW) -> tuple[list[tuple], list[tuple]]:
    """Copy factors (start, length, ref, ref_start) and duplicate spans (start, length) of a document of n words.

    hit: the places, ascending, whose windows stand in the reference, at ref_start of the document ref. The factors don't overlap.
    """
    factors, spans, cursor = [], [], 0
    run = np.zeros(len(hit), bool)  # whether a window goes on where the one before it left the reference
    run[1:] = (hit[1:] == hit[:-1] + 1) & (ref[1:] == ref[:-1]) & (ref_start[1:] == ref_start[:-1] + 1)
    ends = np.append(np.flatnonzero(~run)[1:], len(hit)) if len(hit) else hit
    last = np.repeat(ends, np.diff(np.append(np.flatnonzero(~run), len(hit)))) - 1 if len(hit) else hit
    i = 0
    while i < len(hit):
        j = int(last[i])
        length = int(hit[j] - hit[i]) + window
        factors.append((int(hit[i]), length, int(ref[i]), int(ref_start[i])))
        cursor = int(hit[i]) + length
        i = int(np.searchsorted(hit, cursor))
    covered = np.zeros(n + 1, np.int64)
    # the factors' own windows, and those looked up at their boundaries
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + window, -1)
    inside = np.concatenate([[0], (np.cumsum(covered)[:-1] > 0).astype(np.int8), [0]])
    step = np.diff(inside)
    for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
        spans.append((a, b - a))
    return factors, spans


def _parse(window: int):
    def run(batches):
        for whole in batches:
            for batch in in_arrow_batches(whole, _SLICE):
                t = Tokens(batch.column(1))
                h, g = _window_hashes(t, window)
                removed, kept, factors, duplicate = [], [], [], []
                texts, hits = batch.column(1).to_pylist(), batch.column(3)
                for d in range(batch.num_rows):
                    lo, hi = int(t.first[d]), int(t.first[d + 1])
                    own = hits[d].values
                    keys = own.field("h").to_numpy(zero_copy_only=False).view(np.uint64)
                    order = np.argsort(keys)
                    keys = keys[order]
                    of = [own.field(x).to_numpy(zero_copy_only=False)[order] for x in ("g", "ref", "place")]
                    mine = h[lo : max(hi - window + 1, lo)]
                    k = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                    at = np.flatnonzero((keys[k] == mine) & (of[0][k].astype(np.uint64) == g[lo : lo + len(mine)]))
                    f, spans = parse(hi - lo, at, of[1][k[at]], of[2][k[at]] >> 32, window)
                    words, left, done = (texts[d] or "").encode().split(), [], 0
                    for start, n in spans:
                        left += words[done:start]
                        done = start + n
                    left += words[done:]
                    removed.append(len(words) - len(left))
                    kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
                    factors.append([dict(zip(("start", "length", "ref", "ref_start"), x)) for x in f])
                    duplicate.append([{"start": a, "length": n} for a, n in spans])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(factors, pa.list_(_FACTOR)), pa.array(duplicate, pa.list_(_SPAN))],
                    ["doc_id", "k", "r", "kept", "f", "s"],
                )

    return run


def _row(text: Column) -> Column:
    """What tells rows of one doc_id apart: 32 bits of the text."""
    return F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))


def factored(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, factors array<struct<start,length,ref,ref_start>>, spans array<struct<start,length>> for
    each row of docs.

    A window's reference is the smallest doc_id that has it. Documents with equal words are settled at once: all but the smallest
    doc_id are one copy factor. Windows are judged on the input. Null texts have no words; a row without a doc_id is neither cut
    nor a reference; rows that repeat a doc_id are judged by their own texts, equal ones alike (only a smaller doc_id makes a
    copy); other columns of docs, whatever their names, are not looked at; a very long text comes alone in its batch; an empty
    table gives an empty result.
    """
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), _row(F.coalesce(text, F.lit(""))).alias("k"))
    profile = materialize(small_batches(docs).mapInArrow(trimmed(_profile(window, gram)), "doc_id long, k long, n_words long, sha string, anchors array<long>"), "rlz-profile")
    firsts = materialize(profile.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("first")), "rlz-firsts")
    settled = profile.select("doc_id", "k", "n_words", "sha").join(firsts, "sha", "left")
    entries = profile.join(firsts, (profile["sha"] == firsts["sha"]) & (F.col("doc_id") == F.col("first"))).select("doc_id", "k", F.explode("anchors").alias("anchor"))
    shared = entries.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    live = materialize(entries.join(shared, "anchor").groupBy("doc_id", "k").agg(F.collect_set("anchor").alias("live")), "rlz-live")
    texts = materialize(docs.join(live, ["doc_id", "k"]).select("doc_id", "text", "k", "live").dropDuplicates(["doc_id", "k"]), "rlz-texts")
    windows = materialize(texts.mapInArrow(trimmed(_windows(window, gram)), "h long, g int, doc_id long, place long"), "rlz-windows")
    least = windows.groupBy("h", "g").agg(F.min("doc_id").alias("ref"), F.max("doc_id").alias("top"), F.min_by("place", "doc_id").alias("ref_place")).where("ref < top").select("h", "g", "ref", "ref_place")
    hits = windows.join(materialize(least, "rlz-least"), ["h", "g"]).where(F.col("ref") < F.col("doc_id"))
    hits = hits.groupBy("doc_id", F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("k")).agg(F.collect_list(F.struct("h", "g", "ref", F.col("ref_place").alias("place"))).alias("hits"))
    kind = "doc_id long, k long, r long, kept string, f array<struct<start:int,length:int,ref:long,ref_start:int>>, s array<struct<start:int,length:int>>"
    cut = texts.select("doc_id", "text", "k").join(hits, ["doc_id", "k"]).select("doc_id", "text", "k", "hits").mapInArrow(trimmed(_parse(window)), kind)
    copy = (F.col("first") < F.col("doc_id")) & (F.col("n_words") >= window)
    n = F.col("n_words").cast("int")
    whole, span = F.array(F.struct(F.lit(0).alias("start"), n.alias("length"), F.col("first").alias("ref"), F.lit(0).alias("ref_start"))), F.array(F.struct(F.lit(0).alias("start"), n.alias("length")))
    return settled.join(cut, ["doc_id", "k"], "left").select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("r", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.col("f")).alias("factors"), F.when(copy, span).otherwise(F.col("s")).alias("spans"),
    )
