"""The tagger against all taggings, one by one, and on held-out sentences."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from quillwork.functions import stem
from quillwork.operators import drivers, tagger

NOUNS, VERBS, ADJECTIVES = ("rea", "ul", "ment"), ("esc", "ez", "ind"), ("os", "iv", "al")


def sentences(r, n):
    """Determiner, adjectives, noun, verb, full stop; a word of verb ending after a determiner is a noun."""
    stems = ["car", "dom", "lib", "mun", "fer", "sol", "tin", "vas"]
    out = []
    for k in range(n):
        new = stems + ["".join(r.choice("bcdfglmn") + r.choice("aeiou") for _ in range(3))]
        words, tags = [], []
        for _ in range(r.randint(1, 3)):
            words += ["un"] + [r.choice(new) + r.choice(ADJECTIVES) for _ in range(r.randint(0, 2))]
            tags += ["DT"] + ["JJ"] * (len(words) - len(tags) - 1)
            words += [r.choice(new) + r.choice(NOUNS + (("ind",) if tags[-1] == "DT" else ())), r.choice(new) + r.choice(VERBS)]
            tags += ["NN", "VB"]
        out.append((k, [*words, "."], [*tags, "."]))
    return out


def test_viterbi_is_best():
    r = np.random.default_rng(1)
    for n, length in ((2, 5), (3, 4), (4, 3)):
        moves = np.log(r.random((n + 1, n + 1, n)))
        words = [[{"tag": k, "lp": float(r.normal())} for k in range(n) if k == 0 or r.random() < 0.8] for _ in range(length)]

        def score(path):
            before = [-1, -1, *path]
            return sum(moves[before[i] + 1, before[i + 1] + 1, c] + next(x["lp"] for x in words[i] if x["tag"] == c) for i, c in enumerate(path))

        best = max(itertools.product(*[[x["tag"] for x in w] for w in words]), key=score)
        assert tuple(tagger._viterbi(moves, words)) == best


def test_moves_are_interpolated():
    counts = {(0, 0, 0): 3, (0, 1, 1): 3, (1, 2, 0): 2, (2, 1, 1): 1}
    moves = np.exp(tagger._moves(counts, 2))
    seen = moves[0, 0], moves[0, 1], moves[1, 2]
    assert all(math.isclose(p.sum(), 1, rel_tol=1e-9) for p in seen) and moves[0, 1, 1] > moves[0, 1, 0]


def test_counts(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["X", "Y", "Y"]), (["a"], ["X"]), ([], []), (None, None), (["c", "d"], ["X"])], "words array<string>, tags array<string>")
    m = tagger.train(df)
    lexicon = {r["word"]: {x["tag"]: round(math.exp(x["lp"]), 6) for x in r["candidates"]} for r in m.lexicon.collect()}
    assert m.tags == ["X", "Y"] and lexicon == {"a": {0: round(2 / 3, 6), 1: 0.5}, "b": {1: 0.5}, "c": {0: round(1 / 3, 6)}}
    assert {r["key"]: r["counts"] for r in m.suffixes.collect()} == {"a": [3, 2], "aa": [2, 1], "ab": [0, 1], "ac": [1, 0]}


def test_held_out(spark, monkeypatch):
    rows = sentences(random.Random(3), 500)
    df = spark.createDataFrame(rows, "sent_id long, words array<string>, tags array<string>").repartition(3)
    model = tagger.train(df.where("sent_id >= 150"))
    new = df.where("sent_id < 150").select("sent_id", "words")
    for most in (tagger.BROADCAST, 3):  # candidates broadcast, and mostly shuffled
        monkeypatch.setattr(tagger, "BROADCAST", most)
        got = {r["sent_id"]: r["tags"] for r in tagger.tagged(model, new, "sent_id", "words").collect()}
        right = [a == b for k, _, gold in rows[:150] for a, b in zip(gold, got[k])]
        assert len(got) == 150 and sum(right) / len(right) > 0.98


def test_odd_sentences(spark):
    model = tagger.train(spark.createDataFrame(sentences(random.Random(4), 40), "sent_id long, words array<string>, tags array<string>"))
    df = spark.createDataFrame([(1, [], "u"), (2, None, "v"), (3, ["", None, "Р", "x" * 50000], "w"), (4, ["un", "carul"] * 300, "u")], "k long, w array<string>, at string")
    got = {r["k"]: r["o"] for r in tagger.annotated(model, df, "k", "w", "o").collect()}
    assert got[1] == [] and got[2] == [] and len(got[3]) == 4 and len(got[4]) == 600 and got[4][0]["tag"] == "DT"
    assert tagger.tagged(model, df.limit(0), "k", "w").count() == 0


def test_pairs_with_the_tagger(spark):
    """Rules that hang on parts of speech fire, which no plain annotation lets them."""
    upos = spark.createDataFrame([("DT", "DET"), ("NN", "NOUN"), ("VB", "VERB"), ("JJ", "ADJ"), (".", "PUNCT")], "ptb string, upos string")
    model = tagger.train(spark.createDataFrame(sentences(random.Random(5), 300), "sent_id long, words array<string>, tags array<string>"), upos)
    pairs = spark.createDataFrame([(0, "un carul domesc .", "un domul domesc ."), (1, "un carul domesc .", "un carul ."), (2, "un carul solesc .", "un carul solind ."), (3, "un carul .", "un carul ."), (4, "un libul .", "un liboase .")], "row_idx long, source string, target string")
    words = spark.createDataFrame([(w,) for w in ("carul", "domesc", "solesc", "libul")], "word string")
    blocks = drivers.annotate_pairs(pairs, ["target"], model, words, stem=lambda t: stem.romanian(t["text"]))
    got = {r["sent_id"]: [e["err_type"] for e in r["edits"]] for r in blocks.collect()}
    assert got[0] == ["R:NOUN"] and got[1] == ["U:VERB"] and got[3] == ["noop"] and got[2][0].startswith("R:VERB") or got[2] == ["R:MORPH"]
    again = {r["sent_id"]: [e["err_type"] for e in r["edits"]] for r in drivers.reannotate(blocks, "auto", model, words).collect()}
    assert again[0] == ["R:NOUN"] and again[1] == ["U:VERB"] and {r["sent_id"]: r["edits"][0]["err_type"] for r in drivers.reannotate(blocks, "gold", model, words).collect()}[1] == "U:VERB"
