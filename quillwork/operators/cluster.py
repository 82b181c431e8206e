"""Feature clustering: standardise, project, assign to the nearest centre with a confidence, and quality metrics.

Points are rows (id, x array<double>[, cluster int]).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.tables import dealt, written

FEATURES = ("S_ref", "S_per_x", "S_per_y", "edge_density", "anisotropy")
#: The silhouette: points packed in a row, rows whose distances are taken at once, bytes of points that a task holds against its own,
#: and sums that a task gathers before they leave it.
BLOCK, ROWS, RIGHT, MOST = 2048, 64, 128 << 20, 1 << 20
#: Squares of distances below this share of the points' own squares are taken by differences.
NEAR = 1e-4


def as_points(df: DataFrame, id_: str, columns: list[str] | tuple[str, ...] = FEATURES) -> DataFrame:
    """id, x from single feature columns, as float32 values."""
    return df.select(F.col(id_).alias("id"), F.array(*[F.col(c).cast("float").cast("double") for c in columns]).alias("x"))


def dims(points: DataFrame, *keys: str) -> DataFrame:
    """keys, d, v: a row for each coordinate."""
    return points.select(*keys, F.posexplode("x").alias("d", "v"))


def moments(points: DataFrame) -> DataFrame:
    """One row: mu, sd array<double>, means and population deviations by coordinate."""
    m = dims(points).groupBy("d").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    m = m.agg(F.array_sort(F.collect_list(F.struct("d", "m", "s"))).alias("a"))
    return m.select(F.transform("a", lambda e: e["m"]).alias("mu"), F.transform("a", lambda e: e["s"]).alias("sd"))


def zscore(points: DataFrame, stats: DataFrame) -> DataFrame:
    """points with x replaced by (x - mu) / (sd + 1e-8); stats is one row."""
    z = F.zip_with(F.zip_with("x", "mu", lambda a, b: a - b), "sd", lambda a, s: a / (s + 1e-8))
    return points.crossJoin(F.broadcast(stats)).withColumn("x", z).drop("mu", "sd")  # one row


def project(points: DataFrame, mean: list[float], components: list[list[float]]) -> DataFrame:
    """points with x replaced by (x - mean) . components^T."""
    centred = F.zip_with("x", F.array(*[F.lit(float(m)) for m in mean]), lambda a, m: a - m)
    dot = lambda row: F.aggregate(F.zip_with(centred, F.array(*[F.lit(float(w)) for w in row]), lambda a, w: a * w), F.lit(0.0), lambda s, v: s + v)
    return points.withColumn("x", F.array(*[dot(r) for r in components]))


def fit_pca(points: DataFrame, k: int = 2) -> dict:
    """mean, components (k rows), evr: sums of products by Spark, eigenvectors on the driver; each component's largest entry is positive."""

    def products(parts):
        for pdf in parts:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy())
                x = np.concatenate([np.ones((len(x), 1)), x], 1)
                i, j = np.triu_indices(x.shape[1])
                yield pd.DataFrame({"i": i, "j": j, "v": (x.T @ x)[i, j]})

    sums = points.select("x").mapInPandas(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # (d + 1)^2 / 2 rows
    s = np.zeros((1 + max(r["j"] for r in sums),) * 2)
    for r in sums:
        s[r["i"], r["j"]] = s[r["j"], r["i"]] = r["v"]
    n, means = s[0, 0], s[0, 1:] / s[0, 0]
    cov = s[1:, 1:] / n - np.outer(means, means)
    values, vectors = np.linalg.eigh(cov)
    top = np.argsort(-values)[:k]
    comps = vectors[:, top].T
    comps = comps * np.sign(comps[np.arange(len(top)), np.abs(comps).argmax(1)])[:, None]
    return {"mean": means.tolist(), "components": comps.tolist(), "evr": (values[top] / max(values.sum(), 1e-12)).tolist()}


def fit_kmeans(points: DataFrame, k: int = 3, seed: int = 0, iterations: int = 300) -> DataFrame:
    """cluster, c array<double>: centres of Spark's k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="v").fit(points.select(array_to_vector("x").alias("v")))
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())]
    return points.sparkSession.createDataFrame(rows, "cluster int, c array<double>")


def centres(points: DataFrame, k: int | None = None) -> DataFrame:
    """cluster, c: mean vectors; with k, clusters 0..k-1 without points get a zero vector."""
    by = dims(points, "cluster").groupBy("cluster", "d").agg(F.avg("v").alias("v")).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("a"))
    out = by.select("cluster", F.transform("a", lambda e: e["v"]).alias("c"))
    if k is not None:
        size = points.agg(F.max(F.size("x")).alias("n"))
        out = points.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster")).join(out, "cluster", "left").crossJoin(size).select("cluster", F.coalesce("c", F.array_repeat(F.lit(0.0), F.col("n").cast("int"))).alias("c"))
    return out


def squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def assign(points: DataFrame, centre_rows: DataFrame) -> DataFrame:
    """points with nearest int, d1, d2, confidence: the nearest centre (the lowest number at ties) and 1 - d1 / (d1 + d2 + 1e-8)
    of the two least squared distances. All centres are gathered as one row of k vectors, so that each point is scored in
    place: no row is multiplied and nothing but that row is broadcast."""
    every = centre_rows.agg(F.array_sort(F.collect_list(F.struct("cluster", "c"))).alias("_cs"))
    d = F.array_sort(F.transform("_cs", lambda e: F.struct(squared(F.col("x"), e["c"]).alias("d"), e["cluster"].alias("cluster"))))
    out = points.crossJoin(F.broadcast(every)).withColumn("_d", d).drop("_cs")  # one row
    d1, d2 = F.col("_d")[0]["d"], F.col("_d")[1]["d"]
    return out.withColumn("nearest", F.col("_d")[0]["cluster"]).withColumn("d1", d1).withColumn("d2", d2).withColumn("confidence", 1 - d1 / (d1 + d2 + 1e-8)).drop("_d")


def confidence_summary(assigned: DataFrame) -> DataFrame:
    """One row: mean, median, p10, p90 (interpolated) of confidence."""
    q = F.percentile("confidence", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return assigned.agg(F.avg("confidence").alias("mean"), q.alias("q")).select("mean", F.col("q")[1].alias("median"), F.col("q")[0].alias("p10"), F.col("q")[2].alias("p90"))


def per_cluster(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy(F.col("nearest").alias("cluster")).agg(F.avg("confidence").alias("mean_confidence"), F.count("*").alias("n"))


def _blocks(points: DataFrame, block: int) -> DataFrame:
    """b, n, d, wide, ids, clusters, x: points packed, at most `block` to a row, in order of their cluster; x are doubles if wide, else
    floats, where these are the same numbers."""
    kind = dict(points.dtypes)
    names = ["id", "cluster", "x"]

    def packed(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.take(pc.sort_indices(rows, [("cluster", "ascending")]))
        x = np.stack([np.asarray(v, float) for v in rows["x"].to_pylist()])
        with np.errstate(over="ignore"):
            short = x.astype(np.float32)
        wide = not np.array_equal(short, x, equal_nan=True)
        lists = [pa.ListArray.from_arrays([0, len(rows)], rows[c].combine_chunks()) for c in names[:2]]
        return pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([wide]), *lists, pa.array([(x if wide else short).tobytes()], pa.binary())], ["n", "d", "wide", "ids", "clusters", "x"])

    def run(batches):
        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch)
            n += len(batch)
            if n >= block:
                rows = pa.Table.from_batches(waiting)
                for at in range(0, n - n % block, block):
                    yield packed(rows.slice(at, block))
                waiting, n = rows.slice(n - n % block).to_batches(), n % block
        if n:
            yield packed(pa.Table.from_batches(waiting))

    rows = points.select(*names).mapInArrow(run, f"n int, d int, wide boolean, ids array<{kind['id']}>, clusters array<{kind['cluster']}>, x binary")
    return written(rows.withColumn("b", F.monotonically_increasing_id()), "silhouette-blocks")


def distance_sums(x: np.ndarray, y: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the distances of each row of x to the runs of rows of y that begin at starts. Squares are taken by one product of matrices;
    where two points are so near that this loses digits, or a number isn't finite, by their differences."""
    with np.errstate(all="ignore"):
        nx, ny = (x * x).sum(1), (y * y).sum(1)
        usual = bool(np.isfinite(nx).all() and np.isfinite(ny).all())
        left = np.concatenate([-2 * x, np.ones((len(x), 1)), nx[:, None]], 1)
        right = np.ascontiguousarray(np.concatenate([y, ny[:, None], np.ones((len(y), 1))], 1).T)
        out = np.empty((len(x), len(starts)))
        for at in range(0, len(x), ROWS):
            if usual:
                sq = left[at : at + ROWS] @ right
                if sq.min() <= NEAR * (nx[at : at + ROWS].max() + ny.max()):
                    i, j = np.nonzero(sq <= NEAR * (nx[at : at + ROWS, None] + ny))
                    for k in range(0, len(i), 1 << 14):
                        p, q = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
                        sq[p, q] = ((x[at + p] - y[q]) ** 2).sum(1)
            else:
                sq = np.stack([((v - y) ** 2).sum(1) for v in x[at : at + ROWS]])
            out[at : at + ROWS] = np.add.reduceat(np.sqrt(sq, out=sq), starts, axis=1)
    return out


def silhouette_rows(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """id, cluster, a, b, s for each point (Euclidean). s = (b - a) / (max(a, b) + 1e-8), a = 0 for a cluster of one; null for one cluster.

    Every distance has to be taken, but no pair is a row, and no point is copied for the blocks it meets: points are packed into blocks,
    written once, and each part of the blocks reads all blocks from there (a product of rows that are blocks, RIGHT bytes held by a task).
    What leaves a task is a sum by point and cluster.
    """
    blocks = _blocks(points, block)
    held = blocks.agg(F.sum(F.col("n") * F.when(F.col("wide"), F.col("d") * 8).otherwise(F.col("d") * 4)).alias("bytes")).first()["bytes"] or 0
    mine = dealt(blocks.select("b", "wide", "d", "ids", "clusters", "x"))
    every = blocks.select(*[F.col(c).alias(f"{c}_") for c in ("wide", "d", "clusters", "x")]).coalesce(-(-held // RIGHT) or 1)
    kind = dict(points.dtypes)

    def matrix(row: dict, end: str) -> np.ndarray:
        return np.frombuffer(row[f"x{end}"].as_buffer(), float if row[f"wide{end}"].as_py() else np.float32).reshape(-1, row[f"d{end}"].as_py()).astype(float)

    def run(batches):
        at, x, ids, clusters, sums, sizes = None, None, None, None, {}, {}

        def told():
            """What the block at hand has come to."""
            for k in range(0, len(ids) if sums else 0, rows := max(1, MOST // max(len(sums), 1))):
                some, m = range(k, min(k + rows, len(ids))), len(sums)
                index, others = np.repeat(np.asarray(some), m), pa.array(list(sums), clusters.type)
                total = np.stack([t[k : k + rows] for t in sums.values()], 1).ravel()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(index)), clusters.take(pa.array(index)), others.take(pa.array(np.tile(np.arange(m), len(some)))), pa.array(total), pa.array(np.tile(list(sizes.values()), len(some)), pa.int64())], ["id", "cluster", "other", "total", "n"])
            sums.clear()
            sizes.clear()

        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                if row["b"].as_py() != at:
                    yield from told()
                    at, x, ids, clusters = row["b"].as_py(), matrix(row, ""), row["ids"].values, row["clusters"].values
                coded = row["clusters_"].values.dictionary_encode(null_encoding="encode")
                code = coded.indices.to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                found, names, counts = distance_sums(x, matrix(row, "_"), starts), coded.dictionary.to_pylist(), np.diff([*starts, len(code)])
                for j, run_at in enumerate(starts):
                    name = names[code[run_at]]
                    sums[name] = sums[name] + found[:, j] if name in sums else found[:, j]
                    sizes[name] = sizes.get(name, 0) + int(counts[j])
                if len(sums) * len(ids) > MOST:
                    yield from told()
        if at is not None:
            yield from told()

    part = mine.crossJoin(every.hint("shuffle_replicate_nl")).mapInArrow(run, f"id {kind['id']}, cluster {kind['cluster']}, other {kind['cluster']}, total double, n bigint")
    total = part.groupBy("id", "cluster", "other").agg(F.sum("total").alias("t"), F.sum("n").alias("n"))
    own = F.col("cluster") == F.col("other")
    a = F.max(F.when(own & (F.col("n") > 1), F.col("t") / (F.col("n") - 1)))
    rows = total.groupBy("id", "cluster").agg(F.coalesce(a, F.lit(0.0)).alias("a"), F.min(F.when(~own, F.col("t") / F.col("n"))).alias("b"))
    return rows.withColumn("s", (F.col("b") - F.col("a")) / (F.greatest("a", "b") + 1e-8))


def silhouette(points: DataFrame) -> DataFrame:
    return silhouette_rows(points).agg(F.avg("s").alias("silhouette"))


def davies_bouldin(points: DataFrame) -> DataFrame:
    """One row: davies_bouldin. Only k x k centre pairs are formed."""
    c = centres(points)
    scat = points.join(F.broadcast(c) if c.count() <= 10_000 else c, "cluster").groupBy("cluster", "c").agg(F.avg(F.sqrt(squared(F.col("x"), F.col("c"))) + 1e-8).alias("s"))
    a, b = scat.select(F.col("cluster").alias("i"), F.col("c").alias("ci"), F.col("s").alias("si")), scat.select(F.col("cluster").alias("j"), F.col("c").alias("cj"), F.col("s").alias("sj"))
    r = a.join(b, F.col("i") != F.col("j"), "left").groupBy("i").agg(F.max(F.coalesce((F.col("si") + F.col("sj")) / (F.sqrt(squared(F.col("ci"), F.col("cj"))) + 1e-8), F.lit(0.0))).alias("r"))
    return r.agg(F.avg("r").alias("davies_bouldin"))


def reasons(centre_rows: DataFrame, columns: tuple[str, ...] = FEATURES, top: int = 2) -> DataFrame:
    """cluster, name, reason: the features of a standardised centre with the largest absolute values, with their direction."""
    named = F.transform("c", lambda v, i: F.struct((-F.abs(v)).alias("k"), i.alias("i"), F.concat(F.when(v < 0, "low ").otherwise("high "), F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in columns]), i + 1), F.concat(F.lit("x"), i))).alias("t")))
    best = F.transform(F.slice(F.array_sort(named), 1, top), lambda e: e["t"])
    return centre_rows.select("cluster", F.concat(F.lit("cluster "), F.col("cluster"), F.lit(": "), best[0]).alias("name"), F.array_join(best, ", ").alias("reason"))


def fit(points: DataFrame, k: int = 3, seed: int = 0, use_pca: bool = False) -> dict:
    """The whole model as a dictionary: space, mu, sd, pca, centers, k, seed."""
    stats = moments(points).first()
    z = zscore(points, moments(points))
    pca = fit_pca(z)
    space = project(z, pca["mean"], pca["components"]) if use_pca else z
    c = fit_kmeans(space, k, seed)
    labels = assign(space, c).select("id", F.col("nearest").alias("cluster"))
    own = centres(z.join(labels, "id"), k)
    info = {r["cluster"]: (r["name"], r["reason"]) for r in reasons(own).collect()}  # k rows
    return {"k": k, "seed": seed, "space": "pca2" if use_pca else "zscore", "mu": list(stats["mu"]), "sd": list(stats["sd"]), "pca": pca, "centers": {r["cluster"]: list(r["c"]) for r in c.collect()}, "names": info}


def predict(points: DataFrame, model: dict) -> DataFrame:
    """id, cluster, cluster_name, confidence (three places, text), reason."""
    spark = points.sparkSession
    z = zscore(points, spark.createDataFrame([(model["mu"], model["sd"])], "mu array<double>, sd array<double>"))
    space = project(z, model["pca"]["mean"], model["pca"]["components"]) if model["space"] == "pca2" else z
    c = spark.createDataFrame([(int(k), v) for k, v in model["centers"].items()], "cluster int, c array<double>")
    names = F.broadcast(spark.createDataFrame([(int(k), *v) for k, v in model["names"].items()], "nearest int, cluster_name string, reason string"))  # k rows
    return assign(space, c).join(names, "nearest", "left").select("id", F.col("nearest").alias("cluster"), "cluster_name", F.format_string("%.3f", "confidence").alias("confidence"), "reason")


def ranked_centres(points: DataFrame, centre_rows: DataFrame) -> DataFrame:
    """id, cluster, d2, place: every centre of each point by distance (a report; k rows a point)."""
    d = points.crossJoin(F.broadcast(centre_rows)).select("id", centre_rows["cluster"], squared(F.col("x"), F.col("c")).alias("d2"))  # k rows
    return d.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("d2", "cluster")))
