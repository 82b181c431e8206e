"""Quality rules: exact document counts, and line labelling by a linear-chain CRF whose content share decides retention."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from .common import _BYTE, _INVERSE, _ODD, Tokens, discard, in_arrow_batches, materialize, mix64, powers, small_batches, trimmed, whole_row, window_hash, without
from .crf import ChainCRF

SYMBOLS = b"[#*$%&|<>]"[1:-1]
#: Bounds of the sample of labelled rows that the CRF is fitted on: documents, and lines of all of them. Documents come whole.
TRAIN_DOCS, TRAIN_LINES = 4000, 100_000
#: Documents, not copies of each other, in which a line stands again to be boilerplate.
SHARED = 3
CONTENT_SHARE, MIN_WORDS = 0.5, 50
_SLICE = 1 << 19


def _per(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set between successive bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[bounds])


def _times(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key how often it occurs, and whether it occurred before."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    group = np.cumsum(new) - 1
    times, again = np.empty(len(k), np.int64), np.empty(len(k), bool)
    times[order] = np.bincount(group)[group] if len(k) else 0
    again[order] = ~new
    return times, again


class Lines:
    """The \\n-split lines of a batch of texts: counts of each text and features of each line with a word."""

    def __init__(self, texts: pa.Array):
        t = self.t = Tokens(texts)
        data, words = t.data, t.hash
        size = len(data)
        lead = (data & 0xC0) != 0x80
        space = (data == 32) | ((data >= 9) & (data <= 13))
        symbol = np.isin(data, np.frombuffer(SYMBOLS, np.uint8))
        self.n_words = np.diff(t.first)
        self.word_chars = _per(lead & ~space, t.offsets)
        self.n_symbols = _per(symbol, t.offsets)
        # words of repeated three-word windows
        covered = np.zeros(len(words) + 1, np.int64)
        if len(words) >= 3:
            inside = np.flatnonzero(t.doc[:-2] == t.doc[2:])
            key = window_hash(words, 3)[inside] ^ mix64(t.doc[inside].astype(np.uint64) + _ODD)
            twice = inside[_times(key)[0] > 1]
            np.add.at(covered, twice, 1)
            np.add.at(covered, twice + 3, -1)
        repeated = np.cumsum(covered)[:-1] > 0
        self.n_repeat_words = _per(repeated, t.first)
        # lines
        begins = np.unique(np.concatenate([t.offsets[:-1], np.flatnonzero(data == 10) + 1]))
        begins = begins[begins < size]
        ends = np.append(begins[1:], size)
        first = np.searchsorted(t.start, np.append(begins, size))
        has = np.diff(first) > 0
        begins, ends, first, last = begins[has], ends[has], first[:-1][has], first[1:][has]
        doc = t.doc[first]
        stop = ends - ((ends > begins) & (data[np.maximum(ends - 1, 0)] == 10) if size else 0)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(_ODD, size), out=total[1:])
        line = (total[stop] - total[begins]) * powers(_INVERSE, size + 1)[begins] + (stop - begins).astype(np.uint64)
        self.line = mix64(line)
        times, again = _times(self.line ^ mix64(doc.astype(np.uint64) + _ODD))
        self.n_dup_lines = np.bincount(doc[again], minlength=t.n)
        self.first = np.searchsorted(doc, np.arange(t.n + 1))
        self.words = last - first
        bounds = np.stack([begins, ends], 1).ravel()

        def share(flags: np.ndarray) -> np.ndarray:
            total = np.zeros(size + 1, np.int64)
            np.cumsum(flags, out=total[1:])
            return total[ends] - total[begins]

        chars, upper, digit = share(lead & ~space), share((data >= 65) & (data <= 90)), share((data >= 48) & (data <= 57))
        lower = share((data >= 97) & (data <= 122))
        over = np.cumsum(np.append(0, repeated))
        del bounds
        self.x = np.stack([
            np.log1p(self.words), chars / self.words, share(symbol) / chars, share(data == 124) / self.words, upper / (upper + lower + 1), digit / chars,
            share(data == 33) / self.words, share((data == 46) | (data == 63)) / self.words, (over[last] - over[first]) / self.words, times > 1, again, np.isin(data[t.end[last - 1] - 1], (46, 63, 33)),
            share((data == 64) | (data == 47)) / self.words, self.words < 4,
        ], 1).astype(np.float64) if len(begins) else np.zeros((0, 14))


FEATURES = 14


def marked(x: np.ndarray) -> np.ndarray:
    """Lines that look like boilerplate by themselves: symbols, menus and tables, capitals, exclamations, digits, or repetition."""
    symbols, pipes, upper, digits, shouts, repeated, line_again = x[:, 2], x[:, 3], x[:, 4], x[:, 5], x[:, 6], x[:, 8], x[:, 9]
    return (symbols > 0.05) | (pipes > 0.3) | (upper > 0.6) | (digits > 0.5) | (shouts > 0.5) | (repeated > 0.5) | (line_again > 0)


def line_labels(quality: list[int], xs: list[np.ndarray], lines: list[np.ndarray]) -> list[np.ndarray]:
    """Weak labels (1: content) of the lines of documents, from their looks, their spread and the document's label.

    Marked lines and those that stand in SHARED documents are boilerplate. The others are content in a document of quality 1. In one
    of quality 0 they are content where boilerplate holds half of the words or more, and so explains the label; else all is
    boilerplate. Documents half of whose lines stand in earlier ones are copies and don't count for the spread.
    """
    spread: dict[int, int] = {}
    for own in lines:
        each = set(own.tolist())
        if 2 * sum(h not in spread for h in each) > len(each):
            for h in each:
                spread[h] = spread.get(h, 0) + 1
    out = []
    for q, x, own in zip(quality, xs, lines):
        bad = marked(x) | np.array([spread.get(h, 0) >= SHARED for h in own.tolist()], bool)
        words = np.expm1(x[:, 0])
        explained = 2 * words[bad].sum() >= words.sum()
        out.append((~bad & (q == 1 or explained)).astype(int))
    return out


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, most_lines: int = TRAIN_LINES) -> ChainCRF:
    """A CRF (state 1: content) from the lines of labelled documents, labelled weakly by line_labels().

    Takes at most `most` labelled documents, those of the least hash of their id; of these, in that order, each that keeps the sum of
    lines within most_lines, whole. Without labels of both kinds all is content.
    """
    picked = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select(F.xxhash64("doc_id").alias("at"), F.xxhash64("text").alias("th"), "quality", "text")

    def features(batches):
        for whole in batches:
            for batch in in_arrow_batches(whole, _SLICE):
                lines = Lines(batch.column(3))
                for k in range(batch.num_rows):
                    for lo in range(lines.first[k], lines.first[k + 1], 4096):
                        hi = min(lo + 4096, lines.first[k + 1])
                        own = [pa.array([lo - int(lines.first[k])]), pa.array([hi - lo]), pa.array([lines.x[lo:hi].astype(np.float32).tobytes()], pa.binary()), pa.array([lines.line[lo:hi].tobytes()], pa.binary())]
                        yield pa.RecordBatch.from_arrays([batch.column(c).slice(k, 1) for c in range(3)] + own, ["at", "th", "quality", "lo", "n", "x", "line"])

    table = materialize(small_batches(rows).mapInArrow(trimmed(features), "at long, th long, quality int, lo long, n long, x binary, line binary"), "quality-lines")
    total, chosen = 0, []
    for r in sorted(table.groupBy("at", "th").agg(F.sum("n").alias("n")).collect()):  # a row a document of the sample
        if total + r["n"] <= most_lines:
            total += r["n"]
            chosen.append((r["at"], r["th"]))
    spark = docs.sparkSession
    got: dict[tuple, list] = {}
    if chosen:
        own = table.join(F.broadcast(spark.createDataFrame(chosen, "at long, th long")), ["at", "th"])
        for r in sorted(own.select("at", "th", "lo", "quality", "x", "line").distinct().collect(), key=lambda r: r[:3]):  # most_lines lines at most
            got.setdefault((r["at"], r["th"], r["quality"]), []).append((np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES), np.frombuffer(r["line"], np.uint64)))
    discard(table)
    crf = ChainCRF(FEATURES)
    quality = [k[2] for k in got]
    if len(set(quality)) < 2:
        crf.w[-1] = 1.0
        return crf
    xs = [np.concatenate([x for x, _ in parts]).astype(np.float64) for parts in got.values()]
    ys = line_labels(quality, xs, [np.concatenate([h for _, h in parts]) for parts in got.values()])
    return crf.fit(np.concatenate(xs), np.concatenate(ys), np.append(0, np.cumsum([len(x) for x in xs])))


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_ADDED = (*_COUNTS, "base_failed", "content_share", "kept")


def _assessed(docs: DataFrame, crf: ChainCRF) -> DataFrame:
    """row (whole_row) of each row of docs, and the columns of _ADDED."""
    frame = docs.select(F.col("text").cast("string").alias("text"), whole_row(docs))

    def run(batches):
        for whole in batches:
            for batch in in_arrow_batches(whole, _SLICE):
                lines = Lines(batch.column(0))
                state = crf.decode(lines.x, lines.first)
                content = np.bincount(np.repeat(np.arange(lines.t.n), np.diff(lines.first)), lines.words * state, lines.t.n)
                failed = (lines.n_words < MIN_WORDS) | (100 * lines.n_repeat_words > 50 * lines.n_words)
                share = content / np.maximum(lines.n_words, 1)
                numbers = [pa.array(getattr(lines, c).astype(np.int64)) for c in _COUNTS]
                yield pa.RecordBatch.from_arrays([batch.column(1), *numbers, pa.array(failed), pa.array(share), pa.array(~failed & (share >= CONTENT_SHARE))], ["row", *_ADDED])

    kinds = [LongType()] * len(_COUNTS) + [BooleanType(), DoubleType(), BooleanType()]
    schema = StructType([frame.schema["row"], *[StructField(c, k) for c, k in zip(_ADDED, kinds)]])
    return small_batches(frame).mapInArrow(trimmed(run), schema)


def assess(docs: DataFrame, crf: ChainCRF, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept,
    which take the place of columns of these names.

    content_share: words in lines that Viterbi decoding marks as content, over all words. Null or empty texts have no words and
    fail; every row is judged by itself, so repeated rows, ties and null ids change nothing; a very long text comes alone in its
    batch; an empty table stays empty.
    """
    own = docs.select("text", *[c for c in keep if c != "text"])
    return _assessed(own, crf).select(*without(own.select(*keep), _ADDED), *_ADDED)


def kept(docs: DataFrame, crf: ChainCRF) -> DataFrame:
    """The rows of docs, whole, that assess() keeps; docs may have columns of any names."""
    return _assessed(docs, crf).where("kept").select("row.*")
