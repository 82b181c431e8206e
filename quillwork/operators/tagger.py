"""A part-of-speech tagger: a trigram hidden Markov model with suffix guesses (Brants, 2000), counted by Spark, decoded by Viterbi.

Everything that grows with the words is a table: the lexicon, the counts of suffixes, the candidates of the words to be tagged. Only what
the tag set bounds reaches the driver and the tasks: the numbers of tags and of their trigrams.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions.tables import written

from .align import TOKEN

#: Letters of the longest suffix; words seen at most RARE times teach suffixes; words of a lexicon or guesses broadcast at most.
SUFFIX, RARE, BROADCAST, MOST_TAGS = 8, 10, 100_000, 200
_CANDIDATES = "array<struct<tag:int,lp:double>>"


@dataclass
class Model:
    """tags in order; moves[a + 1, b + 1, c]: log probability of tag c after a, b (0 stands before the sentence); prior: tags' shares;
    lexicon: word, candidates; suffixes: key, counts (by tag)."""

    tags: list[str]
    moves: np.ndarray
    prior: np.ndarray
    lexicon: DataFrame
    suffixes: DataFrame
    upos: dict[str, str] = field(default_factory=dict)


def _suffixes(word: Column) -> Column:
    """The keys of a word's suffixes, from the longest, with its case: they teach and guess apart."""
    case = F.when(word.rlike(r"^\p{Lu}"), "A").otherwise("a")
    n = F.least(F.length(word), F.lit(SUFFIX))
    return F.transform(F.sequence(n, F.lit(0), F.lit(-1)), lambda k: F.concat(case, F.right(F.lower(word), k)))


def _moves(counts: dict[tuple[int, int, int], int], n: int) -> np.ndarray:
    """Trigram probabilities smoothed by deleted interpolation: each trigram votes, with its count less one, for the order that foretells
    it best."""
    three = np.zeros((n + 1, n + 1, n))
    for (a, b, c), k in counts.items():
        three[a, b, c] = k
    two, one = three.sum(0), three.sum((0, 1))
    before3, before2, total = three.sum(2), two.sum(1), one.sum()
    votes = np.zeros(3)
    for a, b, c in zip(*np.nonzero(three)):
        less = lambda x, y: (x - 1) / (y - 1) if y > 1 else 0.0
        each = (less(one[c], total), less(two[b, c], before2[b]), less(three[a, b, c], before3[a, b]))
        votes[int(np.argmax(each))] += three[a, b, c]
    share = votes / max(votes.sum(), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = share[0] * one / max(total, 1) + share[1] * np.nan_to_num(two / before2[:, None])[None] + share[2] * np.nan_to_num(three / before3[..., None])
    return np.log(np.maximum(p, 1e-12))


def train(tagged: DataFrame, upos: DataFrame | None = None) -> Model:
    """The model of tagged sentences (words array<string>, tags array<string>, of equal lengths; the rest of a longer one is left out).
    upos: a table (ptb, upos) that names the universal tag of each tag; tags it lacks stay as they are."""
    pairs = tagged.select(F.filter(F.arrays_zip(F.col("words").alias("word"), F.col("tags").alias("tag")), lambda x: x["word"].isNotNull() & x["tag"].isNotNull()).alias("p"))
    each = written(pairs.select(F.explode("p").alias("x")).groupBy("x.word", "x.tag").agg(F.count("*").alias("n")), "tagger-words")
    totals = {r["tag"]: r["n"] for r in each.groupBy("tag").agg(F.sum("n").alias("n")).collect()}
    if not 0 < len(totals) <= MOST_TAGS:
        raise ValueError(f"a tagger learns 1 to {MOST_TAGS} tags, these are {len(totals)}")
    tags = sorted(totals)
    number = F.create_map(*[F.lit(x) for k, t in enumerate(tags) for x in (t, k)])
    own = pairs.select(F.transform("p", lambda x: number[x["tag"]] + 1).alias("t")).where(F.size("t") > 0)
    before = F.concat(F.array(F.lit(0), F.lit(0)), "t")
    triples = own.select(F.explode(F.transform("t", lambda t, i: F.struct(F.get(before, i).alias("a"), F.get(before, i + 1).alias("b"), (t - 1).alias("c")))).alias("x"))
    counts = {(a, b, c): k for a, b, c, k in triples.groupBy("x.a", "x.b", "x.c").count().collect()}  # at most (tags + 1)**2 * tags
    total = np.array([totals[t] for t in tags], float)
    log_total = F.array(*[F.lit(float(np.log(x))) for x in total])
    coded = each.withColumn("k", number[F.col("tag")])
    word = F.struct(F.col("k").cast("int").alias("tag"), (F.log("n") - F.get(log_total, F.col("k"))).alias("lp"))
    lexicon = written(coded.groupBy("word").agg(F.sort_array(F.collect_list(word)).alias("candidates"), F.sum("n").alias("n")), "tagger-lexicon")  # at most as many as tags
    rare = coded.join(lexicon.where(F.col("n") <= RARE).select("word"), "word")
    of = rare.select(F.explode(_suffixes(F.col("word"))).alias("key"), "k", "n").groupBy("key", "k").agg(F.sum("n").alias("n"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(len(tags) - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0)))
    suffixes = of.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(F.col("k").cast("int"), F.col("n").cast("long")))).alias("m")).select("key", dense.alias("counts"))
    names = {r["ptb"]: r["upos"] for r in upos.where(F.col("ptb").isin(*tags)).collect()} if upos is not None else {}
    return Model(tags, _moves(counts, len(tags)), total / total.sum(), lexicon.select("word", "candidates"), written(suffixes, "tagger-suffixes"), names)


def _checked(small: DataFrame) -> DataFrame:
    """small, broadcast if it is counted to be so."""
    return F.broadcast(small) if small.limit(BROADCAST + 1).count() <= BROADCAST else small


def guesses(model: Model, words: DataFrame) -> DataFrame:
    """word, candidates of the distinct words, unknown to the lexicon: from the shortest suffix on, each known one draws the estimate towards
    its own shares (P = (share + theta * P) / (1 + theta), theta the deviation of the tags' shares)."""
    prior, theta, n = model.prior, float(model.prior.std()) or 1.0, len(model.tags)

    def run(batches):
        for batch in batches:
            out = []
            for rows in batch.column(1).to_pylist():
                p = prior
                for r in sorted((r for r in rows if r["counts"]), key=lambda r: r["length"]):
                    c = np.array(r["counts"], float)
                    p = (c / c.sum() + theta * p) / (1 + theta)
                with np.errstate(divide="ignore"):
                    lp = np.log(p) - np.log(prior)
                out.append([{"tag": k, "lp": float(lp[k])} for k in range(n) if p[k] > 1e-4])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("tag", pa.int32()), ("lp", pa.float64())])))], ["word", "candidates"])

    each = words.select("word", F.explode(_suffixes(F.col("word"))).alias("key")).join(_checked(model.suffixes), "key", "left")
    return each.groupBy("word").agg(F.collect_list(F.struct(F.length("key").alias("length"), "counts")).alias("s")).mapInArrow(run, f"word string, candidates {_CANDIDATES}")


def _viterbi(moves: np.ndarray, sentence: list[list[dict]]) -> list[int]:
    """The best tags of a sentence of candidates: states are pairs of tags, those that a word's candidates allow."""
    best: dict[tuple[int, int], float] = {(0, 0): 0.0}
    back: list[dict] = []
    for candidates in sentence:
        then: dict[tuple[int, int], float] = {}
        came: dict[tuple[int, int], int] = {}
        for (a, b), score in best.items():
            row = moves[a, b]
            for c in candidates:
                own = score + row[c["tag"]] + c["lp"]
                key = (b, c["tag"] + 1)
                if own > then.get(key, -np.inf):
                    then[key], came[key] = own, a
        best = then
        back.append(came)
    state = max(best, key=lambda k: (best[k], (-k[0], -k[1])))
    out = []
    for came in reversed(back):
        out.append(state[1] - 1)
        state = (came[state], state[0])
    return out[::-1]


def tagged(model: Model, rows: DataFrame, key: str, words: str) -> DataFrame:
    """key, tags: the tags of rows' words (array<string>; nulls count as empty words). Sentences without words have no row; key is one a row.

    Candidates are looked up for distinct words; frequent words, counted, meet their candidates by broadcast and the others by a shuffled join.
    """
    each = rows.select(F.col(key).alias("_key"), F.posexplode(F.transform(words, lambda w: F.coalesce(w, F.lit("")))).alias("at", "word"))
    often = written(each.groupBy("word").agg(F.count("*").alias("k")), "tagger-asked")
    known = often.join(model.lexicon, "word", "left")
    found = known.where("candidates is not null").select("word", "candidates", "k")
    new = guesses(model, known.where("candidates is null").select("word")).join(often, "word").select("word", "candidates", "k")
    looked = written(found.unionByName(new), "tagger-candidates")
    head = F.broadcast(looked.orderBy(F.desc("k"), "word").limit(BROADCAST).select("word", F.col("candidates").alias("head")))
    met = each.join(head, "word", "left")
    if looked.limit(BROADCAST + 1).count() > BROADCAST:
        rest = met.where("head is null").drop("head").join(looked.select("word", F.col("candidates").alias("head")), "word")
        met = met.where("head is not null").unionByName(rest.select(met.columns))
    lists = met.groupBy("_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.col("head").alias("c")))), lambda x: x["c"]).alias("c"))
    moves, names = model.moves, model.tags
    kind = dict(lists.dtypes)["_key"]

    def run(batches):
        for batch in batches:
            out = [[names[k] for k in _viterbi(moves, s)] for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["_key", "_tags"])

    return lists.mapInArrow(run, f"_key {kind}, _tags array<string>").select(F.col("_key").alias(key), F.col("_tags").alias("tags"))


def annotated(model: Model, rows: DataFrame, key: str, words: str, out: str) -> DataFrame:
    """rows with out, their words (array<string>) as array<TOKEN>: the tag, its universal part of speech, the lower-cased word for lemma,
    and the dependency that the part of speech alone tells (punct, case, mark, or dep)."""
    upos = F.create_map(*[F.lit(x) for t in model.tags for x in (t, model.upos.get(t, t))])

    def token(w: Column, t: Column) -> Column:
        pos = F.coalesce(upos[t], F.lit("X"))
        dep = F.when(pos == "PUNCT", "punct").when(pos == "ADP", "case").when(pos == "SCONJ", "mark").otherwise("dep")
        return F.struct(w.alias("text"), F.lower(w).alias("lemma"), pos.alias("pos"), F.coalesce(t, F.lit("")).alias("tag"), dep.alias("dep"))

    both = rows.join(tagged(model, rows, key, words).withColumnRenamed("tags", "_tags"), key, "left")
    return both.withColumn(out, F.coalesce(F.zip_with(words, "_tags", token), F.array()).cast(f"array<{TOKEN}>")).drop("_tags")
