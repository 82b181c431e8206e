"""The trained tagger: gradients against differences, restarts, prediction against a loop a token, datasets that settle apart."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwork.functions.tables import shared_dir
from quillwork.operators import loop, net, tags

VOCAB = [tags.KEEP, tags.DELETE, "$REPLACE_bună", "$APPEND_,"]
SMALL = net.Config(rows=256, width=6, steps=6, epochs=6, cold=2, patience=6, rate=0.2, cold_rate=0.3)


def sentences(r, n, first=0):
    """'x' goes, 'buna' is replaced, a comma comes after 'da' unless 'nu' follows."""
    out = []
    for k in range(n):
        w = [r.choice(["da", "nu", "x", "buna", "ziua", "azi"]) for _ in range(r.randint(1, 9))]
        t = [tags.DELETE if a == "x" else "$REPLACE_bună" if a == "buna" else "$APPEND_," if a == "da" and (w + [""])[i + 1] != "nu" else tags.KEEP for i, a in enumerate(w)]
        out.append((first + k, w, t))
    return out


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(1)
    shape = "sent_id long, tokens array<string>, tags array<string>"
    return spark.createDataFrame(sentences(r, 300) + [(900, [], []), (901, None, None), (902, ["da", None], ["$NEW"])], shape).repartition(3).persist(), spark.createDataFrame(sentences(r, 80, 1000), shape)


def test_gradient(spark, data):
    """Against differences of the loss, at some weights of either group; the same however the rows are dealt."""
    enc = net.encoded(data[0], VOCAB, SMALL.rows).persist()
    model, weights = net.started(VOCAB, SMALL).model, np.array([0.5, 2.0, 1.0, 1.5])
    grads, loss, weight = net.gradient(enc, model, weights)
    rows = enc.collect()
    f = np.concatenate([np.array(r["f"]) for r in rows])
    y = np.concatenate([np.array(r["y"]) for r in rows])
    assert (y == -1).sum() == 2
    f, y = f[y >= 0], y[y >= 0]

    def plain(m):
        p = net.probabilities(m, f)[np.arange(len(y)), y]
        return float((-np.log(p) * weights[y]).sum() / weights[y].sum())

    assert abs(loss - plain(model)) < 1e-6 and abs(weight - weights[y].sum()) < 1e-6
    for which, at in ((0, (int(f[0, 0]), 2)), (0, (int(f[5, 4]), 0)), (1, (1, 3)), (1, (2, SMALL.width))):
        own = [model.embedding, model.layer][which]
        was, ends = own[at], []
        for d in (1e-5, -1e-5):
            own[at] = was + d
            ends.append(plain(model))
        own[at] = was
        assert abs((ends[0] - ends[1]) / 2e-5 - grads[which][at]) < 1e-5
    again = net.gradient(enc.repartition(11), model, weights)[0]
    assert all((a == b).all() for a, b in zip(grads, again))


def test_schedule():
    got = [net.scheduled(k, 20, 0.1) for k in range(21)]
    assert got[:3] == [0, 0.5, 1.0] and got[20] == 0 and all(a > b for a, b in zip(got[2:], got[3:]))


@pytest.fixture(scope="module")
def trained(spark, data):
    path, states = f"{shared_dir(spark)}/net-state", {}

    def saved(state):
        net.save(spark, state, f"{path}-{state.epoch}")
        states[state.epoch] = state.model.embedding.copy()

    return net.train(*data, VOCAB, {tags.DELETE: 2.0}, SMALL, saved=saved), path, states


def test_training(spark, data, trained):
    state, path, states = trained
    first, last = state.history[0], state.history[-1]
    assert last["loss"] < 0.5 * first["loss"] and state.best > 0.9 and state.epoch == 6
    assert (states[1] == states[2]).all() and (states[2] != states[3]).any()  # two epochs with the embedding as it was
    again = net.train(*data, VOCAB, {tags.DELETE: 2.0}, SMALL, resume=net.load(spark, f"{path}-3"))
    assert (again.model.embedding == state.model.embedding).all() and (again.model.layer == state.model.layer).all() and again.history == state.history


def test_patience(data):
    still = net.Config(rows=64, width=2, steps=1, epochs=9, cold=0, patience=2, rate=0.0, cold_rate=0.0)
    state = net.train(*data, VOCAB, config=still)
    assert state.epoch == 2 + (state.best > 0) and state.waited == 2


def test_prediction_token_by_token(spark, data, trained):
    model = trained[0].best_model
    rows = [(k, " ".join(w)) for k, w, _ in sentences(random.Random(7), 60)] + [(500, "da"), (501, "")]
    df = spark.createDataFrame(rows, "sent_id long, text string").repartition(3)
    feats = {r["sent_id"]: r["f"] for r in df.select("sent_id", net.features(F.split("text", " "), SMALL.rows).alias("f")).collect()}

    def one(k, text):
        """A round of correction, a token at a time."""
        out = []
        for word, f in zip(text.split(" "), feats[k]):
            p = net.probabilities(model, np.array([f]))[0]
            tag = model.tags[int(p.argmax())] if p.max() >= 0.8 else tags.KEEP
            out += [] if tag == tags.DELETE else ["bună"] if tag == "$REPLACE_bună" else [word, ","] if tag == "$APPEND_," else [word]
        return " ".join(out)

    got = {r["sent_id"]: r["text"] for r in loop.correct(df, net.predictor(model, 7), 0.8, 1).collect()}
    assert got == {k: one(k, t) for k, t in rows if t} and got[500] == "da ,"


def test_datasets(spark, tmp_path):
    fixes = spark.createDataFrame([("a", "$REPLACE_b", 1.0), ("b", "$REPLACE_c", 1.0), ("c", "$REPLACE_d", 1.0)], "word string, tag string, conf double")
    asked = []

    def counting(toks):
        asked.append(sorted(r[0][0] for r in toks.select("sent_id").collect()))
        return loop.dictionary_predictor(fixes)(toks)

    rows = [("long", 1, "a x"), ("long", 2, "y"), ("short", 1, "c"), ("still", 1, " z "), ("still", 3, "  ")]
    df = spark.createDataFrame(rows, "dataset string, sent_id long, text string")
    got = sorted(tuple(r) for r in loop.correct_datasets(df, counting, rounds=4, path=str(tmp_path / "d")).collect())
    want = []
    for d in ("long", "short", "still"):
        own = loop.correct(df.where(F.col("dataset") == d).select("sent_id", "text"), loop.dictionary_predictor(fixes), rounds=4)
        want += [(d, r["sent_id"], r["iteration"], r["text"]) for r in own.collect()]
    assert got == sorted(want)
    assert asked == [["long", "long", "short", "still"], ["long", "long", "short"], ["long", "long"], ["long", "long"]]
    assert (tmp_path / "d" / "dataset=short" / "iteration=2").is_dir() and not (tmp_path / "d" / "dataset=still" / "iteration=2").exists()
