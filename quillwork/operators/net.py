"""A token tagger trained and run on Spark: hashed features, an embedding and a linear layer over the tags.

Two groups of weights stand for encoder and classifier: rows of the embedding, and the layer with its bias. A step is one job over its
minibatch: a task adds up the gradients of its tokens by weight row, Spark adds the tasks' rows, and the driver, which holds no more than
the weights, makes the step. Gradients are whole numbers of 2**-30 when they are added, so that sums don't hang on their order and a
restart goes on as if it had not stopped.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType, IntegerType, StructField, StructType

from quillwork.functions.tables import written
from quillwork.functions.text import let

from .tags import KEEP

_UNIT = float(1 << 30)
#: Features of a token: itself, its neighbours, its first and last letters, and its neighbours together.
FEATURES = 7
#: Tokens whose gradients are held at once.
_CHUNK = 1024


@dataclass(frozen=True)
class Config:
    """rows and width of the embedding; steps an epoch; epochs, of which the first `cold` leave the embedding as it is; the two learning
    rates; the share of all steps in which the rate rises before it falls to zero; epochs without a better score before the end."""

    rows: int = 4096
    width: int = 16
    steps: int = 8
    epochs: int = 10
    cold: int = 2
    patience: int = 3
    rate: float = 1e-2
    cold_rate: float = 5e-2
    warm_up: float = 0.1
    decay: float = 0.01
    clip: float = 1.0
    beta: float = 0.5
    seed: int = 42


@dataclass
class Model:
    """tags; embedding (rows, width); layer (tags, width + 1), the last column being the bias."""

    tags: list[str]
    embedding: np.ndarray
    layer: np.ndarray


@dataclass
class State:
    """What training goes on from: weights, moments of the gradients, steps and epochs done, the best epoch's score and weights, what
    each epoch came to."""

    model: Model
    first: list[np.ndarray]
    second: list[np.ndarray]
    step: int
    epoch: int
    best: float
    waited: int
    best_model: Model
    history: list[dict]


def features(tokens: Column, rows: int) -> Column:
    """array<array<int>>: for each token FEATURES rows of the embedding, by hashes."""
    def at(low: Column) -> Column:
        word = lambda i: F.coalesce(F.get(low, i), F.lit(""))
        each = lambda w, i: (
            F.struct(F.lit(0), w), F.struct(F.lit(1), word(i - 1)), F.struct(F.lit(2), word(i + 1)), F.struct(F.lit(3), F.left(w, F.lit(2))),
            F.struct(F.lit(4), F.right(w, F.lit(3))), F.struct(F.lit(5), F.right(w, F.lit(1))), F.struct(F.lit(6), word(i - 1), word(i + 1)),
        )
        return F.transform(low, lambda w, i: F.array(*[F.pmod(F.xxhash64(f), F.lit(rows)).cast("int") for f in each(w, i)]))

    return let(F.transform(tokens, lambda w: F.lower(F.coalesce(w, F.lit("")))), at)


def encoded(sentences: DataFrame, tags: list[str], rows: int) -> DataFrame:
    """sent_id, f (features), y (tag numbers, -1 where a token has no known tag) of sentences (sent_id, tokens, tags); no token, no row."""
    number = F.create_map(*[F.lit(x) for k, t in enumerate(tags) for x in (t, k)])
    y = F.transform("tokens", lambda _, i: F.coalesce(number[F.get("tags", i)], F.lit(-1)))
    return sentences.where(F.size("tokens") > 0).select("sent_id", features(F.col("tokens"), rows).alias("f"), y.alias("y"))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The features (tokens, FEATURES) and tag numbers of all tokens of a batch."""
    f = batch.column(0).flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
    return f, batch.column(1).flatten().to_numpy(zero_copy_only=False)


def hidden(model: Model, f: np.ndarray) -> np.ndarray:
    """The mean of each token's embedding rows, and a one for the bias."""
    return np.concatenate([model.embedding[f].mean(1), np.ones((len(f), 1))], 1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _gradients(model: Model, weights: np.ndarray):
    """row, n, loss, weight and the sums of a task: rows below len(embedding) are the embedding's, the rest the layer's; one more row has
    the loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, width = model.embedding.shape
        sums = np.zeros((rows + len(model.tags) + 1, width + 1), np.int64)
        for batch in batches:
            every, known = _flat(batch)
            every, known = every[known >= 0], known[known >= 0]
            for at in range(0, len(known), _CHUNK):
                f, y = every[at : at + _CHUNK], known[at : at + _CHUNK]
                h = hidden(model, f)
                p = softmax(h @ model.layer.T)
                w = weights[y]
                sums[-1, 0] += int(np.rint(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)) * w * _UNIT).sum())
                sums[-1, 1] += int(np.rint(w * _UNIT).sum())
                p[np.arange(len(y)), y] -= 1.0
                p *= w[:, None]
                sums[rows:-1] += np.rint(p[:, :, None] * h[:, None, :] * _UNIT).astype(np.int64).sum(0)
                back = np.rint(p @ model.layer[:, :-1] / FEATURES * _UNIT).astype(np.int64)
                for k in range(FEATURES):
                    np.add.at(sums[:, :-1], f[:, k], back)
        touched = np.flatnonzero(sums.any(1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(touched), pa.array(list(sums[touched]), pa.list_(pa.int64()))], ["row", "sums"])

    return run


def gradient(data: DataFrame, model: Model, weights: np.ndarray) -> tuple[list[np.ndarray], float, float]:
    """The gradients of embedding and layer, the loss and the weight of all tokens of data (f, y): means over the weight."""
    rows, width = model.embedding.shape
    part = data.select("f", "y").mapInArrow(_gradients(model, weights), "row int, sums array<long>")
    added = part.groupBy("row").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width + 1)]).collect()  # as many rows as weights have
    total = np.zeros((rows + len(model.tags) + 1, width + 1))
    for row, *s in added:
        total[row] = s
    total /= _UNIT
    weight = total[-1, 1]
    return [total[:rows, :-1] / max(weight, 1e-12), total[rows:-1] / max(weight, 1e-12)], total[-1, 0] / max(weight, 1e-12), weight


def scheduled(step: int, total: int, warm_up: float) -> float:
    """The rate's share at a step: it rises over the warm-up and then falls to zero, both in a straight line."""
    rise = int(total * warm_up)
    return step / max(1, rise) if step < rise else max(0.0, (total - step) / max(1, total - rise))


def _stepped(state: State, grads: list[np.ndarray], config: Config, frozen: bool, total: int) -> None:
    """One step of AdamW with clipped gradients; a frozen embedding keeps its moments."""
    own = [np.zeros_like(grads[0]) if frozen else grads[0], grads[1]]
    norm = float(np.sqrt(sum((g * g).sum() for g in own)))
    share, weights = scheduled(state.step, total, config.warm_up), [state.model.embedding, state.model.layer]
    state.step += 1
    for k, rate in enumerate((config.rate, config.cold_rate)):
        if k == 0 and frozen:
            continue
        g = own[k] * min(1.0, config.clip / (norm + 1e-6))
        state.first[k] = 0.9 * state.first[k] + 0.1 * g
        state.second[k] = 0.999 * state.second[k] + 0.001 * g * g
        n = state.step - (config.cold * config.steps if k == 0 else 0)
        move = state.first[k] / (1 - 0.9**n) / (np.sqrt(state.second[k] / (1 - 0.999**n)) + 1e-8)
        weights[k] -= rate * share * (move + config.decay * weights[k])


def counts(data: DataFrame, model: Model) -> dict[str, int]:
    """tokens, right, and tp, fp, fn of the tags other than $KEEP over data (f, y)."""
    kept = model.tags.index(KEEP) if KEEP in model.tags else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(5, np.int64)
        for batch in batches:
            f, y = _flat(batch)
            f, y = f[y >= 0], y[y >= 0]
            if len(y):
                p = (hidden(model, f) @ model.layer.T).argmax(1)
                c += [len(y), (p == y).sum(), ((p == y) & (y != kept)).sum(), ((p != y) & (p != kept)).sum(), ((p != y) & (y != kept)).sum()]
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in c], ["tokens", "right", "tp", "fp", "fn"])

    names = ("tokens", "right", "tp", "fp", "fn")
    found = data.select("f", "y").mapInArrow(run, "tokens long, right long, tp long, fp long, fn long").agg(*[F.sum(c).alias(c) for c in names]).first()
    return {c: found[c] or 0 for c in names}


def f_score(tp: int, fp: int, fn: int, beta: float) -> float:
    p, r = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
    return (1 + beta**2) * p * r / (beta**2 * p + r) if p + r else 0.0


def started(tags: list[str], config: Config) -> State:
    r = np.random.default_rng(config.seed)
    model = Model(tags, r.normal(0, 0.5, (config.rows, config.width)), r.normal(0, 0.1, (len(tags), config.width + 1)))
    shapes = (model.embedding.shape, model.layer.shape)
    return State(model, [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0, 0, 0.0, 0, Model(tags, model.embedding.copy(), model.layer.copy()), [])


def save(spark: SparkSession, state: State, path: str) -> None:
    """The state as a table of one row, over what stood there."""
    arrays = {"e": state.model.embedding, "l": state.model.layer, "fe": state.first[0], "fl": state.first[1], "se": state.second[0], "sl": state.second[1], "be": state.best_model.embedding, "bl": state.best_model.layer}
    rest = {"tags": state.model.tags, "step": state.step, "epoch": state.epoch, "best": state.best, "waited": state.waited, "history": state.history, "shapes": {k: a.shape for k, a in arrays.items()}}
    row = (json.dumps(rest), *[bytearray(a.astype("<f8").tobytes()) for a in arrays.values()])
    spark.createDataFrame([row], "rest string, " + ", ".join(f"{k} binary" for k in arrays)).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> State:
    row = spark.read.parquet(path).first()
    rest = json.loads(row["rest"])
    a = {k: np.frombuffer(bytes(row[k]), "<f8").reshape(shape).copy() for k, shape in rest["shapes"].items()}
    return State(Model(rest["tags"], a["e"], a["l"]), [a["fe"], a["fl"]], [a["se"], a["sl"]], rest["step"], rest["epoch"], rest["best"], rest["waited"], Model(rest["tags"], a["be"], a["bl"]), rest["history"])


def train(sentences: DataFrame, validation: DataFrame, tags: list[str], weights: dict[str, float] | None = None, config: Config = Config(), resume: State | None = None, saved: Callable[[State], None] | None = None) -> State:
    """The state after training on sentences (sent_id, tokens, tags), judged after each epoch on validation by F-beta of the tags other than
    $KEEP: the best epoch's weights are kept, and `patience` epochs without a better one end it. weights: of the classes in the loss (1).

    An epoch deals its sentences anew to `steps` minibatches by a hash. resume goes on from a state; saved is called with the state after
    each epoch.
    """
    data, held = written(encoded(sentences, tags, config.rows), "net-train"), written(encoded(validation, tags, config.rows), "net-held")
    each = np.array([(weights or {}).get(t, 1.0) for t in tags])
    state = resume or started(tags, config)
    total = config.steps * config.epochs
    while state.epoch < config.epochs and state.waited < config.patience:
        losses = []
        for b in range(config.steps):
            batch = data.where(F.pmod(F.xxhash64("sent_id", F.lit(state.epoch), F.lit(config.seed)), F.lit(config.steps)) == b)
            grads, loss, weight = gradient(batch, state.model, each)
            if weight:
                losses.append(loss)
            _stepped(state, grads, config, state.epoch < config.cold, total)
        state.epoch += 1
        c = counts(held, state.model)
        score = f_score(c["tp"], c["fp"], c["fn"], config.beta)
        state.history.append({"epoch": state.epoch, "loss": float(np.mean(losses)) if losses else 0.0, "f": score, **c})
        if score > state.best:
            state.best, state.waited, state.best_model = score, 0, Model(tags, state.model.embedding.copy(), state.model.layer.copy())
        else:
            state.waited += 1
        if saved:
            saved(state)
    return state


def probabilities(model: Model, f: np.ndarray) -> np.ndarray:
    return softmax(hidden(model, f) @ model.layer.T)


def predictor(model: Model, batch_size: int = 1024) -> Callable[[DataFrame], DataFrame]:
    """A predictor of loop.correct(): tags and their confidence (the largest probability; the first of equal ones) of each token. A worker
    makes the model once and puts batches of tokens through it."""
    tags, rows = model.tags, len(model.embedding)

    def load_model():
        def run(f: np.ndarray) -> dict[str, np.ndarray]:
            p = probabilities(model, f.astype(np.int64))
            k = p.argmax(1)
            return {"k": k.astype(np.int32), "p": p[np.arange(len(k)), k].astype(np.float32)}

        return run

    shape = StructType([StructField("k", IntegerType()), StructField("p", FloatType())])
    predicted = predict_batch_udf(load_model, return_type=shape, batch_size=batch_size, input_tensor_shapes=[[FEATURES]])
    named = F.array(*[F.lit(t) for t in tags])

    def predict(toks: DataFrame) -> DataFrame:
        each = toks.select("sent_id", F.posexplode(features(F.col("tokens"), rows)).alias("at", "f"))
        found = each.select("sent_id", "at", predicted("f").alias("x"))
        by = found.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("a"))
        return by.select("sent_id", F.transform("a", lambda e: F.get(named, e["x"]["k"])).alias("tags"), F.transform("a", lambda e: e["x"]["p"].cast("double")).alias("confs"))

    return predict


