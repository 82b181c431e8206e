"""Product codes of vectors: codebooks learned by integer k-means, exact under float32 screening.

The nearest entry of each part is searched with one float32 matrix product a batch. Its rounding error has a proven bound, so every
entry is given an interval; those that overlap the best one's are computed again in int64, and ties fall to the lower index. The codes
are those of integer arithmetic, whatever the order in which a BLAS sums.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, trimmed

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Sums by label are broadcast up to so many labels; beyond, rows and sums meet by label and one of SALTS.
BROADCAST_LABELS, SALTS = 100_000, 16
#: Vectors whose products are held at once.
_ROWS = 2048


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x the index of its nearest entry (squared distance, ties to the lower index), that distance, and the number of
    entries computed again. x and entries: int64 with d columns, magnitudes within reach(d).

    ||x - c||^2 - ||x||^2 = ||c||^2 - 2 x.c, and a float32 product of d terms, in any order of summation, with or without fused
    steps, is within g ||x|| ||c|| of x.c, where g = (d + 2) u / (1 - (d + 2) u), u = 2**-24 (the two more for rounding x and c
    to float32). The rest is float64, whose own rounding is far below the 2**-48 of all terms that is added.
    """
    d = x.shape[1]
    u = 2.0**-24
    g = (d + 2) * u / (1 - (d + 2) * u)
    cols = entries.astype(np.float32).T
    norms = np.einsum("ij,ij->i", entries, entries).astype(np.float64)
    index, least, again = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0
    for at in range(0, len(x), _ROWS):
        some = x[at : at + _ROWS]
        product = (some.astype(np.float32) @ cols).astype(np.float64)
        sizes = np.sqrt(np.einsum("ij,ij->i", some, some).astype(np.float64))[:, None] * np.sqrt(norms)[None, :]
        value = norms - 2 * product
        slack = 2 * g * (1 + 2.0**-20) * sizes + 2.0**-48 * (norms + 2 * sizes) + 2.0**-100
        row, entry = np.nonzero(value - slack <= (value + slack).min(1)[:, None])
        again += len(row)
        diff = some[row] - entries[entry]
        exact = np.einsum("ij,ij->i", diff, diff)
        order = np.lexsort((entry, exact, row))
        first = order[np.unique(row[order], return_index=True)[1]]
        index[at : at + len(some)], least[at : at + len(some)] = entry[first], exact[first]
    return index, least, again


def reach(d: int) -> int:
    """The largest magnitude of components for which the squared distances of PARTS parts of d components add up in a long."""
    return math.isqrt(2**58 // max(d, 1))


def _ints(batch: pa.RecordBatch, column: int, width: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _partial_sums(books: list[np.ndarray]):
    """One row for each part and entry that a task met: part, entry, n, sums."""

    def run(batches):
        d = books[0].shape[1]
        n, sums = np.zeros((PARTS, len(books[0])), np.int64), np.zeros((PARTS, len(books[0]), d), np.int64)
        for batch in batches:
            v = _ints(batch, 0, PARTS * d)
            for p in range(PARTS):
                own = v[:, p * d : (p + 1) * d]
                index = nearest(own, books[p])[0]
                n[p] += np.bincount(index, minlength=len(books[p]))
                np.add.at(sums[p], index, own)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def _codes(books: list[np.ndarray]):
    """vec_id, label, code, error of each vector."""

    def run(batches):
        d = books[0].shape[1]
        for batch in batches:
            v = _ints(batch, 2, PARTS * d)
            found = [nearest(v[:, p * d : (p + 1) * d], books[p])[:2] for p in range(PARTS)]
            code = ["".join(f"{i:02x}" for i in row) for row in np.stack([f[0] for f in found], 1).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(sum(f[1] for f in found))], ["vec_id", "label", "code", "error"])

    return run


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (array<long>) of the vectors without null or non-finite components: v = floor(SCALE * x)."""
    fits = F.col("x").isNotNull() & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x")).where(fits)
    # beyond a long's range only the sign is kept: such vectors are out of reach() and get no code
    whole = lambda e: F.floor(F.greatest(F.least(e * SCALE, F.lit(2.0**62)), F.lit(-(2.0**62)))).cast("long")
    return rows.select("vec_id", "label", F.transform("x", whole).alias("v"))


def _within(dims: int) -> Column:
    return (F.size("v") == dims) & F.forall("v", lambda e: F.abs(e) <= reach(dims // PARTS))


def train(ints: DataFrame) -> list[np.ndarray]:
    """The PARTS codebooks of ints (see integers()), each at most ENTRIES by d: the only rows that reach the driver are these and
    their sums. Each round is one pass: a task sums its vectors by entry, Spark adds the tasks' sums, and each mean is floored."""
    dims = ints.where((F.size("v") > 0) & (F.size("v") % PARTS == 0)).select("vec_id", F.size("v").alias("dims")).orderBy(F.col("vec_id").asc_nulls_last(), "dims").head()
    if dims is None:
        return []
    d = dims["dims"] // PARTS
    own = ints.where(_within(dims["dims"]))
    first = own.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()
    if not first:
        return []
    start = np.array([r[0] for r in first], np.int64)
    books = [start[:, p * d : (p + 1) * d].copy() for p in range(PARTS)]
    for _ in range(ROUNDS):
        partial = small_batches(own.select("v")).mapInArrow(trimmed(_partial_sums(books)), "part int, entry int, n long, sums array<long>")
        added = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(d)])
        books = [b.copy() for b in books]
        for part, entry, n, *sums in added.collect():  # at most PARTS * ENTRIES rows
            books[part][entry] = [s // n for s in sums]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components, in order, as decimals joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def coded(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each row of vectors (vec_id, embedding, label) whose components are all
    finite; the others are dropped.

    code: two hex digits for each of PARTS equal parts; error: squared distance of the floored vector to the entries coded;
    label_error: the errors of all rows with this label (null is one). The length of the smallest vec_id's vector, a multiple of PARTS,
    is that of all: vectors of other lengths, and those with components beyond reach(), teach nothing and have a null code and error.
    Of equal vec_ids the lesser vector comes first, null ids come last; repeated rows are rows; other columns, whatever their names,
    aren't looked at; an empty table gives an empty result.
    """
    ints = materialize(integers(vectors), "codes-integers")
    books = train(ints)
    kind = ints.schema["label"].dataType.simpleString()
    if not books:
        return ints.select("vec_id", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("label_error"), F.lit(digest([])).alias("codebooks_sha256"))
    ok = _within(PARTS * books[0].shape[1])
    rows = small_batches(ints.where(ok)).mapInArrow(trimmed(_codes(books)), f"vec_id {ints.schema['vec_id'].dataType.simpleString()}, label {kind}, code string, error long")
    others = ints.where(~ok).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    rows = materialize(rows.unionByName(others), "codes-rows").withColumn("none", F.col("label").isNull())
    sums = materialize(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "codes-labels")
    key = [rows["label"].eqNullSafe(sums["label"])]
    if sums.count() <= BROADCAST_LABELS:
        both = rows.join(F.broadcast(sums), key, "left")
    else:
        salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS))
        rows, sums = rows.withColumn("salt", salt), sums.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        both = rows.join(sums, [rows["label"].eqNullSafe(sums["label"]), F.col("salt") == F.col("s")], "left")
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
