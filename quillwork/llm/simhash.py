"""SimHash near-duplicates by covering locality-sensitive hashing (Pagh, 2016): no pair within the radius is missed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, in_arrow_batches, materialize, small_batches, trimmed, whole_row

BITS, RADIUS, SHINGLE = 64, 3, 3
#: A bucket with more distinct fingerprints than this is split by further masks instead of being compared pair by pair.
BUCKET = 128


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of the shingles (repeats included) of a text whose A-Z are lower-cased first; no words: 0."""
    words = text.lower().split()  # bytes: ASCII white space and ASCII letters only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size + 1) - 1
        starts = (ends - size).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for a very long text
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for whole in batches:
        for batch in in_arrow_batches(whole, 1 << 20):
            out = np.array([fingerprint((t or "").encode()) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out.view(np.int64))], ["doc_id", "th", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), fp long (the 64 bits, signed) for each row of docs; a null text counts as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    return small_batches(rows).mapInArrow(trimmed(_fingerprints), "doc_id long, th long, fp long")


def covering_masks(free: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the bit positions free: for any radius positions, at least one mask has none of them.

    Position j gets the vector j mod 2**(radius+1) of GF(2)**(radius+1); the mask of a vector v != 0 has the positions whose
    vector has an odd inner product with v. The vectors of radius positions leave a v orthogonal to all of them.
    """
    size = 2 ** (radius + 1)
    return [sum(1 << p for j, p in enumerate(free) if (j % size & v).bit_count() % 2) for v in range(1, size)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def mask_tree(path: tuple[int, ...] = ()) -> list[int]:
    """The cumulative masks below a path: those of the path's bits together with a covering of the bits that stay free."""
    fixed = 0
    for v in path:
        fixed |= covering_masks([p for p in range(BITS) if not fixed >> p & 1])[v]
    return [fixed | m for m in covering_masks([p for p in range(BITS) if not fixed >> p & 1])]


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """All pairs a < b of the distinct values nodes.fp within radius bits of each other.

    Level 1 buckets the values by 15 masks of 32 bits each. A bucket of up to `bucket` values is compared by an equi-join that
    emits only the links; a larger one is split by the 15 masks over its free bits (then 48, 56, 60 bits are equal, so a bucket
    of the last level has at most 16 values). Nothing is capped: each level again covers every pair within the radius.
    """
    spark = nodes.sparkSession
    found, level = None, 0
    table = nodes.select(F.lit(0).cast("long").alias("path"), "fp").withColumn("v", F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(_signed(m)).alias("m")) for i, m in enumerate(mask_tree())])))
    table = table.select(F.col("v.i").alias("path"), F.col("fp").bitwiseAND(F.col("v.m")).alias("key"), "fp")
    while True:
        table = materialize(table, f"simhash-level{level}")
        size = materialize(table.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1"), f"simhash-sizes{level}")
        last = level == 3
        small = table.join(size if last else size.where(F.col("n") <= bucket), ["path", "key"]).select("path", "key", "fp")
        a, b = small.withColumnRenamed("fp", "a"), small.withColumnRenamed("fp", "b")
        near = a.join(b, (a["path"] == b["path"]) & (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
        found = near if found is None else found.unionByName(near)
        large = size.where(F.col("n") > bucket)
        if last or not large.limit(1).count():
            return found.distinct()
        paths = [r[0] for r in large.select("path").distinct().collect()]  # at most 15**(level+1) mask numbers, whatever the data
        below = []
        for p in paths:
            digits, q = [], p
            for _ in range(level + 1):
                digits.append(q % 15)
                q //= 15
            below += [(p, p * 15 + i, _signed(m)) for i, m in enumerate(mask_tree(tuple(reversed(digits))))]
        masks = F.broadcast(spark.createDataFrame(below, "path long, next long, mask long"))  # at most 15**(level+2) rows
        table = table.join(large.select("path", "key"), ["path", "key"]).join(masks, "path").select(F.col("next").alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        level += 1


def _grouped(fps: DataFrame) -> DataFrame:
    """fp, component_id, root (names the component), n_links for each distinct fingerprint of fps (doc_id, th, fp)."""
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    pairs = materialize(links(nodes.select("fp")), "simhash-links")
    roots = components(pairs)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "least")
    by_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of = nodes.join(linked.join(by_root, "root").select("fp", "root", F.col("component_id").alias("c")), "fp", "left").join(degree, "fp", "left")
    return of.select("fp", F.coalesce("c", "least").alias("component_id"), F.coalesce("root", "fp").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, n_links for each row of docs.

    Fingerprints within RADIUS bits are linked; component_id is the smallest doc_id reachable. n_links counts the other
    distinct fingerprints linked to the row's own. Copies share a fingerprint and meet once, as one node, never as pairs.
    Null or empty texts have fingerprint 0 and are linked like others; a repeated row comes out as often as it goes in; a null
    doc_id stays null and never names a component unless all of its ids are null; other columns of docs, whatever their names,
    aren't looked at; a very long text comes alone in its batch; an empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs), "simhash-fps")
    return fps.join(materialize(_grouped(fps), "simhash-groups"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of docs that stay when one of each group does: groups has doc_id, th and group for each row of docs.

    The row of the smallest doc_id stays, null being the largest; of rows of that id the one of the smallest hash of the text.
    """
    best = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "th")).alias("b"))
    # plain keys, the same for the join and the ranks, so that whole rows are shuffled once
    key = lambda doc: (F.coalesce(doc, F.lit(0)).alias("id"), doc.isNull().alias("none"))
    keep = best.select(*key(F.col("b.doc_id")), F.col("b.th").alias("th")).distinct()
    own = docs.select(whole_row(docs), *key(F.col("doc_id").cast("long")), F.xxhash64(F.col("text").cast("string")).alias("th"))
    own = own.join(keep, ["id", "none", "th"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("id", "none", "th").orderBy(F.lit(0)))
    return own.select("row", nth.alias("nth")).where("nth = 1").select("row.*")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs, whole, that stay when one document of each component does: see one_of_each(). Null and empty texts are one
    component; repeated rows are copies; docs may have columns of any names; an empty table gives an empty result."""
    fps = materialize(fingerprints(docs), "simhash-fps")
    groups = fps.join(materialize(_grouped(fps), "simhash-groups"), "fp").select("doc_id", "th", F.col("root").alias("group"))
    return one_of_each(docs, groups)
