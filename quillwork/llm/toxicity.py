"""Toxicity by weak supervision: mined lexicon and pattern voters, a generative label model, a linear classifier.

Voters for toxic are words and word beginnings; voters for not toxic fire where the lexicon is silent; the annotator, where there
is a label, votes either way and may err. The label model estimates all their accuracies, and the correlations among the voters,
by expectation-maximisation over labelled and unlabelled rows; the classifier learns its posteriors.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tokens, in_arrow_batches, small_batches, trimmed

#: Bounds of the samples that the models are fitted on: labelled and unlabelled rows. Most features of the classifier; mine() warns
#: of those beyond, which are the least significant.
TRAIN_ROWS, UNLABELLED_ROWS, VOTERS = 20_000, 10_000, 500
#: Lengths of the word beginnings that are pattern voters; rows that have a feature at least.
PREFIXES, SUPPORT = (3, 4, 5, 6, 7, 8), 3
#: Correlations below this (and below four standard errors) count as none; rows at the prior that each accuracy is smoothed with.
MEANT, SMOOTHING = 0.6, 10.0
_SLICE = 1 << 20


def _words(text):
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, unlabelled: int = UNLABELLED_ROWS) -> DataFrame:
    """toxic, text of at most `most` labelled rows and `unlabelled` others (toxic -1) outside the held-out fold, by the least hash of their id.

    Near copies would turn each of their words into a voter, so rows with the same least hash of a five-word shingle count once.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    known = labels.where("toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    others = ids.join(labels.select("doc_id"), "doc_id", "left_anti").withColumn("toxic", F.lit(-1))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).unionByName(others.orderBy(F.xxhash64("doc_id"), "doc_id").limit(unlabelled).distinct())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")  # most + unlabelled rows
    w = _words(F.col("text"))
    least = F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, 5))))
    rows = rows.withColumn("w", w).withColumn("least", least)
    return rows.groupBy("least", "toxic").agg(F.min(F.struct("doc_id", "text")).alias("x")).select("toxic", "x.text")


class Voters:
    """A voter (or feature) fires on a text that has its word, or a word beginning with its prefix (bytes, A-Z lower-cased)."""

    def __init__(self, found: list[tuple[int, str]], votes: list[bool] | None = None, dropped: int = 0):
        """found: (0, word) or (1, prefix); votes: whether each votes toxic, or is a feature only; dropped: features left out."""
        self.names = found
        self.votes = np.array(votes if votes is not None else [True] * len(found), bool)
        self.dropped = dropped
        self.tables = []
        texts = [t for _, t in found]
        own = Tokens(pa.array(texts, pa.string()), alphanumeric=True).hash if found else np.zeros(0, np.uint64)
        sizes = np.array([0 if kind == 0 else len(t.encode()) for kind, t in found], int)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            at = at[np.argsort(own[at])]
            self.tables.append((int(size), own[at], at))

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How often each voter (column) fires in each text (row)."""
        t = Tokens(texts, lower=True, alphanumeric=True)
        out = np.zeros((t.n, len(self.names)), np.float32)
        for size, keys, at in self.tables:
            words = t.prefix_hash(size) if size else t.hash
            k = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
            hit = np.flatnonzero(keys[k] == words)
            np.add.at(out, (t.doc[hit], at[k[hit]]), 1)
        return out


def mine(rows: DataFrame, most: int = VOTERS) -> Voters:
    """The words and word beginnings whose share of toxic rows differs from the base rate, up or down, beyond chance.

    Beyond chance: a likelihood ratio of more than twice the log of the number of features looked at. Those of which more than half
    of the rows are toxic by the lower bound of the share (95 %) vote; the others are features of the classifier only.
    """
    rows = rows.where("toxic >= 0")
    base = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).first()
    if not base["n"] or not base["k"] or base["k"] == base["n"]:
        return Voters([])
    rate = base["k"] / base["n"]
    w = F.col("w")
    each = F.transform(w, lambda x: F.concat(F.lit("0"), x))  # strings: distinct structs would be found by comparing all pairs
    for size in PREFIXES:
        each = F.concat(each, F.transform(F.filter(w, _at_least(size)), _beginning(size)))
    found = rows.select("toxic", _words(F.col("text")).alias("w")).select("toxic", F.explode(F.array_distinct(each)).alias("f")).groupBy("f").agg(F.sum("toxic").alias("k"), F.count("*").alias("n"))
    k, n = F.col("k"), F.col("n")
    ratio = 2 * (k * F.log(F.greatest(k, F.lit(1)) / (n * rate)) + (n - k) * F.log(F.greatest(n - k, F.lit(1)) / (n * (1 - rate))))
    found = found.where(n >= SUPPORT).withColumn("g", ratio).persist()
    try:
        chance = 2 * np.log(max(found.count(), 2))
        beyond = found.where(F.col("g") > chance)
        order = [F.desc("g"), F.substring("f", 1, 1), F.length("f").desc(), "f"]
        best = beyond.orderBy(*order).limit(8 * most).select(F.substring("f", 1, 1).cast("int"), F.substr("f", F.lit(2)), "k", "n").collect()
        left = beyond.count() - len(best)
    finally:
        found.unpersist()
    chosen, votes, same = [], [], {}
    for kind, v, k_, n_ in best:
        # a beginning or a longer form of one chosen before that fires on as many rows fires on the same rows and says nothing new
        if any(v.startswith(c) or c.startswith(v) for c in same.get((k_, n_), ())):
            continue
        same.setdefault((k_, n_), []).append(v)
        chosen.append((kind, v))
        share, z = k_ / n_, 1.64
        votes.append((share + z * z / (2 * n_) - z * np.sqrt(share * (1 - share) / n_ + z * z / (4 * n_ * n_))) / (1 + z * z / n_) > 0.5)
    dropped = left + max(0, len(chosen) - most)
    if dropped:
        warnings.warn(f"{dropped} significant features beyond the first {most} are left out", stacklevel=2)
    return Voters(chosen[:most], votes[:most], dropped)


def _at_least(size: int):
    return lambda x: F.length(x) >= size


def _beginning(size: int):
    return lambda x: F.concat(F.lit("1"), F.substring(x, 1, size))


class LabelModel:
    """A generative model of the votes: the accuracy of each voter, correlations among them, and the label behind each row.

    A voter that doesn't fire abstains. Accuracies, correlations given the label, the prior and the annotator's error rates are
    estimated by expectation-maximisation over all rows, from a start by the labelled ones; an accuracy is smoothed by SMOOTHING
    rows at the prior. Voters that fire together beyond what the label explains share their weight: each is divided by the sum
    of its correlations. The posterior weighs all votes, so a stray label is smoothed.
    """

    def fit(self, fires: np.ndarray, label: np.ndarray, times: np.ndarray | None = None, rounds: int = 200, within: float = 1e-4) -> LabelModel:
        """fires: rows x voters; label: the annotator's vote, -1 without one; times: how often each row stands for a text.

        Ends when no posterior moves by more than within.
        """
        fires = fires.astype(np.float64)
        times = np.ones(len(fires)) if times is None else times.astype(np.float64)
        one, zero = (label == 1).astype(float), (label == 0).astype(float)
        p, use = one.copy(), times * (label >= 0)
        self.rounds = 0
        while self.rounds < rounds:
            total = use.sum()
            yes, no = use * p, use * (1 - p)
            rest = (fires - np.outer(p, (yes @ fires) / max(yes.sum(), 1e-9)) - np.outer(1 - p, (no @ fires) / max(no.sum(), 1e-9))) * np.sqrt(use)[:, None]
            spread = np.sqrt((rest**2).sum(0)) + 1e-9
            self.correlation = np.clip((rest.T @ rest) / np.outer(spread, spread), -1, 1)
            share = np.where(self.correlation > max(MEANT, 4 / np.sqrt(total)), self.correlation, 0)
            np.fill_diagonal(share, 1)
            self.prior = np.clip(yes.sum() / total, 1e-3, 1 - 1e-3)
            self.accuracy = (yes @ fires + self.prior * SMOOTHING) / (use @ fires + SMOOTHING)
            self.weight = (np.log(self.accuracy / (1 - self.accuracy)) - np.log(self.prior / (1 - self.prior))) / share.sum(0)
            right, wrong = (times * one @ p + 1, times * one @ (1 - p) + 1), (times * zero @ p + 1, times * zero @ (1 - p) + 1)
            of_toxic, of_clean = right[0] + wrong[0], right[1] + wrong[1]
            self.annotator = (right[0] / of_toxic, wrong[1] / of_clean)  # how often it is right, by the true label
            logit = np.log(self.prior / (1 - self.prior)) + fires @ self.weight
            if self.rounds:  # at the start the labels are the truth, not votes
                logit = logit + one * np.log(right[0] / of_toxic / (right[1] / of_clean)) + zero * np.log(wrong[0] / of_toxic / (wrong[1] / of_clean))
            then = 1 / (1 + np.exp(-logit))
            moved, p, use = np.abs(then - p).max(initial=0), then, times
            self.rounds += 1
            if self.rounds > 1 and moved <= within:
                break
        self.posterior = p
        return self


def votes(counts: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Rows x votes: the toxic voters, and two for not toxic, which fire where no voter does and where no feature of any kind does."""
    fires = counts > 0
    return np.concatenate([fires[:, toxic], ~fires[:, toxic].any(1, keepdims=True), ~fires.any(1, keepdims=True)], 1)


def _design(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([counts > 0, np.ones((len(counts), 1))], 1).astype(np.float64)


def classifier(x: np.ndarray, p: np.ndarray, times: np.ndarray | None = None, steps: int = 400, ridge: float = 1e-5) -> np.ndarray:
    """The weights of a logistic regression of the posterior labels p on the rows x, each counted `times` times (Adam, full batch)."""
    share = np.full(len(x), 1 / max(len(x), 1)) if times is None else times / max(times.sum(), 1)
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for step in range(1, steps + 1):
        g = x.T @ (share * (p - 1 / (1 + np.exp(-(x @ w))))) - ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame) -> tuple[Voters, np.ndarray]:
    """Voters and classifier weights learned from rows outside the held-out fold (at most TRAIN_ROWS and UNLABELLED_ROWS).

    Without toxic and non-toxic labels there are no voters and every score is low.
    """
    rows = sample(docs, labels).persist()
    try:
        voters = mine(rows)
        if not voters.names:
            return voters, np.array([-3.0])

        def fired(batches):
            for whole in batches:
                for batch in in_arrow_batches(whole, _SLICE):
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.packbits(x > 0).tobytes() for x in voters.counts(batch.column(1))], pa.binary())], ["toxic", "c"])

        fired_rows = small_batches(rows.select("toxic", "text")).mapInArrow(trimmed(fired), "toxic int, c binary")
        got = sorted((r[0], bytes(r[1]), r[2]) for r in fired_rows.groupBy("toxic", "c").count().collect())  # a bit a voter and row of the sample at most
    finally:
        rows.unpersist()
    bits = np.frombuffer(b"".join(c for _, c, _ in got), np.uint8).reshape(len(got), -1)
    counts = np.unpackbits(bits, axis=1)[:, : len(voters.names)]
    label, times = np.array([y for y, _, _ in got]), np.array([n for _, _, n in got])
    model = LabelModel().fit(votes(counts, voters.votes), label, times)
    return voters, classifier(_design(counts), model.posterior, times)


def scored(docs: DataFrame, voters: Voters, weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score, predicted, n_votes for each row of docs; the score looks at the text only.

    Null and empty texts get the score of a text without a vote. Rows are judged one by one, so repeated rows, ties and null ids
    change nothing; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for whole in batches:
            for batch in in_arrow_batches(whole, _SLICE):
                counts = voters.counts(batch.column(2))
                score = 1 / (1 + np.exp(-(_design(counts) @ weights)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array((counts > 0).sum(1).astype(np.int64))], ["doc_id", "held_out", "score", "predicted", "n_votes"])

    return small_batches(rows).mapInArrow(trimmed(run), "doc_id long, held_out boolean, score double, predicted int, n_votes long")
