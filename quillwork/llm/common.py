"""What the corpus operators share: tables in the shared folder, vectorised hashing, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in the contracts: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir. Unset, a local master (as in tests) gets a temporary one; a cluster
    is an error, for its executors share no machine's folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="quillwork-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: the lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillwork/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillwork_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    path = getattr(df, "_quillwork_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(df: DataFrame) -> DataFrame:
    """df, with Arrow batches of at most 500 rows and 8 MB from now on: Python workers and the JVM's direct memory keep what the
    largest batch took. Plans are lazy, so the session keeps the bounds; they change no result. Smaller ones stay as they are."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 500), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = str(conf.get(key))
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def whole_row(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that no name of theirs meets an operator's own; select("row.*") gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def without(docs: DataFrame, names: tuple[str, ...]) -> list[Column]:
    """The columns of row (whole_row) but those with one of names, whatever the case: an operator's column takes the place of theirs."""
    return [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in {n.lower() for n in names}]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---- vectorised hashing of many texts at once (NumPy) ----

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out[:n]


_INVERSE = np.uint64(pow(int(_ODD), -1, 2**64))


class Tokens:
    """The words of a batch of texts, without a Python object per word: those between white space, or alphanumeric runs.

    data: the bytes of all texts; start, end: byte offsets of each word; doc: the text's number in the batch; first: for each
    text the number of its first word (one more entry than texts); hash: 64 bits per word, equal for equal bytes in any batch.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, alphanumeric: bool = False):
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
        data = data[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.data, self.offsets, self.n = data, offsets, len(texts)
        if alphanumeric:
            space = ~((data >= 128) | ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)) | ((data >= 65) & (data <= 90)))
        else:
            space = (data == 32) | ((data >= 9) & (data <= 13))
        word = np.zeros(len(data) + 1, bool)
        word[:-1] = ~space
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        begins[inner] = word[inner]  # a text's end ends its last word
        ends = np.zeros(len(data) + 1, bool)
        ends[1:] = word[:-1] & ~word[1:]
        if len(inner):
            ends[inner] = word[inner - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.first))

    def _of(self, end: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_total"):
            self._total = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * powers(_ODD, len(self.data)), out=self._total[1:])
            self._back = powers(_INVERSE, len(self.data) + 1)[self.start]
        return mix64((self._total[end] - self._total[self.start]) * self._back + (end - self.start).astype(np.uint64))

    @property
    def hash(self) -> np.ndarray:
        if not hasattr(self, "_hash"):
            self._hash = self._of(self.end)
        return self._hash

    def prefix_hash(self, size: int) -> np.ndarray:
        """The hash of each word's first size bytes; of the whole word if it is shorter."""
        return self._of(np.minimum(self.start + size, self.end))


def window_hash(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each k consecutive entries of words (uint64); len(words) - k + 1 entries."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    base = np.uint64(0xD1342543DE82EF95) + np.uint64(2 * salt)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix64(words + np.uint64(salt)) * powers(base, len(words)), out=total[1:])
    back = powers(np.uint64(pow(int(base), -1, 2**64)), len(words) - k + 1)
    return mix64((total[k:] - total[:-k]) * back)


def in_arrow_batches(batch: pa.RecordBatch, most_bytes: int, column: str = "text"):
    """Slices of batch with at most most_bytes of text each (a longer text comes alone)."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(sizes):
        upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most_bytes, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def trimmed(run):
    """run, a mapInArrow function, handing freed memory back to the system now and then and at its end: workers live on and would
    keep the most that any task took."""

    def trim() -> None:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass

    def wrapped(batches):
        try:
            for k, out in enumerate(run(batches)):
                yield out
                if k % 64 == 63:
                    trim()
        finally:
            trim()

    return wrapped


# ---- connected components ----


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of edges (a long, b long): node long, root long (the component's smallest node).

    Alternating large-star and small-star steps (Kiveris et al., 2014), each one groupBy-min and one equi-join; every round is
    written to the shared folder. A hub costs a partial minimum, and its neighbours are spread by the join's skew handling; no
    group is ever gathered. Stops when a round leaves the edges as they were. Loops and repeated edges are allowed; null ends
    are dropped. No edges give no rows.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        j = both.join(low, "a")
        if large:  # larger neighbours go to the least
            return j.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return j.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))

    def tidy(e: DataFrame) -> DataFrame:
        return e.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now = materialize(tidy(edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())), name)
    before = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == before or not sums[0]:
            break
        before = sums
        then = materialize(tidy(star(tidy(star(now, True)), False)), name)
        discard(now)
        now = then
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
