import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwork.operators import cluster, image, loop, score
from quillwork.sources import io

EDITS = "sent_id long, coder int, start int, end int, err_type string, correction string"


def test_scores_and_keys(spark):
    ref = spark.createDataFrame([(0, 0, 1, 2, "R:SPELL", "x"), (0, 0, 3, 3, "M:DET", "y"), (1, 0, -1, -1, "noop", "-NONE-"), (2, 0, 0, 3, "UNK", "q")], EDITS)
    hyp = spark.createDataFrame([(0, 0, 1, 2, "R:SPELL", "x"), (1, 0, 0, 1, "R:OTHER", "z"), (2, 0, -1, -1, "noop", "-NONE-")], EDITS)
    keys = lambda df, mode: {(r["sent_id"], r["key"]) for r in score.edit_keys(df, mode).collect()}
    assert (0, "3|4") in keys(ref, "token") and {(2, "0|1"), (2, "1|2"), (2, "2|3")} <= keys(ref, "token")
    assert not any(s == 2 for s, _ in keys(ref, "correction"))
    c = score.compare(score.edit_keys(hyp).drop("coder"), score.edit_keys(ref))
    t = score.total(c).first()
    assert (t["tp"], t["fp"], t["fn"], t["p"], t["r"]) == (1, 1, 1, 0.5, 0.5)
    assert {r["cat"] for r in score.by_category(c, 1).collect()} == {"R", "M"}


def test_precision_without_false_positives(spark):
    r = score.with_scores(spark.createDataFrame([(0, 0, 1)], "tp int, fp int, fn int")).first()
    assert (r["p"], r["r"], r["f"]) == (1.0, 0.0, 0.0)


def test_best_annotator_follows_running_totals(spark):
    counts = spark.createDataFrame([(0, 0, "R", 1, 0, 0), (1, 0, "R", 0, 1, 1), (1, 1, "R", 1, 0, 0), (2, 0, "R", 2, 0, 1), (2, 1, "R", 1, 0, 0)], "sent_id long, coder int, cat string, tp long, fp long, fn long")
    sents = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (1, 1, 1), (2, 0, 0), (2, 1, 1)], "sent_id long, coder int, place int")
    assert {r["sent_id"]: r["coder"] for r in score.best_annotator(counts, sents).collect()} == {0: 0, 1: 1, 2: 1}


def brute_silhouette(x, y):
    out = []
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        same = y == y[i]
        a = d[same].sum() / (same.sum() - 1) if same.sum() > 1 else 0.0
        b = min(d[y == c].mean() for c in set(y.tolist()) - {y[i]})
        out.append((b - a) / (max(a, b) + 1e-8))
    return float(np.mean(out))


def test_cluster_metrics(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(41, 4)), np.array([0] * 20 + [1] * 20 + [2])
    p = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "id long, x array<double>, cluster int")
    assert cluster.silhouette_rows(p, block=7).agg(F.avg("s")).first()[0] == pytest.approx(brute_silhouette(x, y))
    c = np.stack([x[y == k].mean(0) for k in range(3)])
    s = np.array([np.sqrt(((x[y == k] - c[k]) ** 2).sum(1)).mean() + 1e-8 for k in range(3)])
    d = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2)) + 1e-8
    want = np.mean([max((s[i] + s[j]) / d[i, j] for j in range(3) if j != i) for i in range(3)])
    assert cluster.davies_bouldin(p).first()[0] == pytest.approx(want)


def test_silhouette_blocks_meet_in_every_partition(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 3)), np.arange(60) % 3
    p = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "id long, x array<double>, cluster int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = cluster.silhouette_rows(p, block=10).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(rows) == 60 and np.mean([r["s"] for r in rows]) == pytest.approx(brute_silhouette(x, y))


def test_confidence_and_ties(spark):
    p = spark.createDataFrame([(0, [0.0]), (1, [1.0])], "id long, x array<double>")
    c = spark.createDataFrame([(0, [1.0]), (1, [-1.0]), (2, [9.0])], "cluster int, c array<double>")
    got = {r["id"]: (r["nearest"], r["confidence"]) for r in cluster.assign(p, c).collect()}
    assert got[0] == (0, pytest.approx(0.5)) and got[1] == (0, pytest.approx(1.0))


def test_model_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(i, [float(i % 3), float(i), 1.0, 0.5, float(i % 2)]) for i in range(30)], "id long, x array<double>")
    m = cluster.fit(p, k=3, use_pca=True)
    io.save_model(spark, m, str(tmp_path / "m"))
    a = cluster.predict(p, io.load_model(spark, str(tmp_path / "m"))).collect()
    assert len(a) == 30 and all(float(r["confidence"]) >= 0.5 - 1e-3 for r in a) and all(r["reason"] for r in a)


def test_image_kernels():
    flat = np.full((12, 10), 0.5, np.float32)
    f = image.features(flat, lag=3)
    assert f["S_ref"] == 0 and f["edge_density"] == 0
    img = np.zeros((20, 20), np.float32)
    img[:, 5:15] = 1
    e = image.edges(img)
    assert image.reflection_score(e, 0.0, 9.5, 1) == pytest.approx(1.0, abs=1e-3)
    assert image.periodicity(np.arange(5.0), 8, 20) == (0.0, 8)
    k = np.arange(9).reshape(3, 3)
    wide = np.pad(e, 1, mode="reflect")
    brute = np.array([[(wide[i : i + 3, j : j + 3] * k).sum() for j in range(20)] for i in range(20)])
    assert np.allclose(image.correlate(e, k), brute, atol=1e-4)
    h = image.features(np.random.default_rng(1).random((16, 24), dtype=np.float32), lag=3)
    assert h["anisotropy"] == pytest.approx(16 / 24, abs=1e-3)


def test_m2_round_trip(spark, tmp_path):
    blocks = "S a b c d\nA 1 2|||R:OTHER|||x|||REQUIRED|||-NONE-|||0\nA 3 4|||U:PUNCT||||||REQUIRED|||-NONE-|||0\n\nS e f\nA -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||0\n\nS g\n"
    (tmp_path / "in.m2").write_text(blocks)
    df = io.read_m2(spark, str(tmp_path / "in.m2"))
    rows = df.orderBy("sent_id").collect()
    assert [r["tokens"] for r in rows] == [["a", "b", "c", "d"], ["e", "f"], ["g"]] and rows[0]["edits"][1]["correction"] == ""
    io.write_m2(df, str(tmp_path / "out"))
    again = io.read_m2(spark, str(tmp_path / "out")).orderBy("sent_id").collect()
    assert [r["edits"] for r in again] == [r["edits"] for r in rows]
    flat = io.flat_edits(df).orderBy("sent_id", "edit_idx").collect()
    assert (flat[2]["start_tok"], flat[2]["err_type"], flat[2]["correction"]) == (-1, "correct", "")
    per = {r["sent_id"]: r for r in io.per_coder(df).collect()}
    assert per[0]["corrected"] == ["a", "x", "c"] and [(e["c_start"], e["c_end"]) for e in per[0]["edits"]] == [(1, 2), (3, 3)]
    assert [(e["c_start"], e["c_end"]) for e in per[1]["edits"]] == [(-1, -1)]


def test_row_order_and_splits(spark, tmp_path):
    (tmp_path / "s.txt").write_text("".join(f"s{i}\n" for i in range(90)))
    (tmp_path / "t.txt").write_text("".join(f"t{i}\n" for i in range(89)))
    p = io.read_parallel(spark, str(tmp_path / "s.txt"), str(tmp_path / "t.txt"))
    assert [(r["row_idx"], r["source"], r["target_0"]) for r in p.orderBy("row_idx").collect()] == [(i, f"s{i}", f"t{i}") for i in range(89)]
    lines = io.split_ordinal(io.read_lines(spark, str(tmp_path / "s.txt"))).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in lines} == {"train": 62, "val": 18, "test": 10}
    io.write_lines(p, "source", str(tmp_path / "o"))
    assert [r["value"] for r in io.read_lines(spark, str(tmp_path / "o")).orderBy("row_idx").collect()] == [f"s{i}" for i in range(89)]


def test_csv_lexicon_vocab(spark, tmp_path):
    import gzip

    (tmp_path / "p.csv").write_text('source,target\n"El a\nmers",El au mers\n,x\n')
    assert [(r["row_idx"], r["dataset"]) for r in io.read_registry(spark, {"d": {"train": str(tmp_path / "p.csv")}}).collect()] == [(0, "d")]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        io.read_pairs_csv(spark, str(tmp_path / "bad.csv"))
    with gzip.open(tmp_path / "l.txt.gz", "wt") as f:
        f.write("merge\tmerge\tVmip3s\nbad line\ncasa\tcasă\tNcfsry\n")
    assert [r["form"] for r in io.read_lexicon(spark, str(tmp_path / "l.txt.gz")).orderBy("row_idx").collect()] == ["merge", "casa"]
    (tmp_path / "v.json").write_text('{"vocab": ["$KEEP", "$DELETE"]}')
    v = io.read_vocab(spark, str(tmp_path / "v.json"))
    assert '"$DELETE": 1' in io.vocab_json(v)


def test_correction_rounds(spark):
    s = spark.createDataFrame([(0, "a of of the"), (1, "clean"), (2, "  ")], "sent_id long, text string")
    fixes = spark.createDataFrame([("of", "$DELETE", 0.9), ("the", "$REPLACE_a", 0.95), ("clean", "$DELETE", 0.1)], "word string, tag string, conf double")
    got = {(r["sent_id"], r["iteration"]): r["text"] for r in loop.correct(s, loop.dictionary_predictor(fixes)).collect()}
    assert got == {(0, i): "a a" for i in (1, 2, 3)} | {(1, i): "clean" for i in (1, 2, 3)}


def test_stream_equals_batch(spark, tmp_path):
    from quillwork.streaming.edits import tag_blocks, tag_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.m2").write_text("S a b c\nA 0 1|||R:OTHER|||au|||REQUIRED|||-NONE-|||0\n\nS x\nA 0 1|||U:OTHER||||||REQUIRED|||-NONE-|||0\n\n")
    q = tag_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("tagged").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = tag_blocks(io.read_m2(spark, str(tmp_path / "in/a.m2")))
    assert sorted(map(str, spark.table("tagged").collect())) == sorted(map(str, want.collect()))


def test_hypotheses_of_sentences_without_reference_edits_count(spark):
    from quillwork.operators import score

    hyp = spark.createDataFrame([(1, "a", "R:X"), (2, "b", "R:X"), (3, "noop", "noop")], "sent_id long, key string, cat string")
    ref = spark.createDataFrame([(1, 0, "a", "R:X"), (1, 1, "c", "R:X")], "sent_id long, coder int, key string, cat string")
    got = sorted((r["sent_id"], r["coder"], r["tp"], r["fp"], r["fn"]) for r in score.compare(hyp, ref).collect())
    assert got == [(1, 0, 1, 0, 0), (1, 1, 0, 1, 1), (2, 0, 0, 1, 0)]


def test_best_annotator_against_a_plain_loop(spark):
    import random

    from quillwork.operators import score

    r = random.Random(3)
    rows = [(s * 40000, c, r.randint(0, 4), r.randint(0, 4), r.randint(0, 4)) for s in range(30) for c in range(r.choice([1, 1, 2, 3]))]
    counts = spark.createDataFrame([(s, c, "X", *n) for s, c, *n in rows], "sent_id long, coder int, cat string, tp long, fp long, fn long")
    sents = spark.createDataFrame([(s, c, c) for s, c, *_ in rows], "sent_id long, coder int, place int")
    total, want = [0, 0, 0], set()

    def f(tp, fp, fn):
        p, q = tp / (tp + fp) if fp else 1.0, tp / (tp + fn) if fn else 1.0
        return round(1.25 * p * q / (0.25 * p + q), 4) if p + q else 0.0

    for s in sorted({x[0] for x in rows}):
        best = max(((f(*[a + b for a, b in zip(n, total)]), n[0], -n[1], -n[2]), -c, c, n) for s_, c, *n in rows if s_ == s)
        want.add((s, best[2]))
        total = [a + b for a, b in zip(total, best[3])]
    assert {(x["sent_id"], x["coder"]) for x in score.best_annotator(counts, sents).collect()} == want


def test_registry_skips_and_reports(spark, tmp_path):
    from quillwork.sources import io

    spark.createDataFrame([("a", "b"), ("c", None)], "source string, target string").coalesce(1).write.csv(str(tmp_path / "x"), header=True)
    spark.createDataFrame([("a",)], "other string").write.csv(str(tmp_path / "y"), header=True)
    got = io.read_registry(spark, {"d": {"train": str(tmp_path / "x"), "val": str(tmp_path / "y"), "test": str(tmp_path / "none")}})
    assert [tuple(r) for r in got.collect()] == [(0, "a", "b", "d", "train")]
    assert io.read_registry(spark, {"d": {"test": str(tmp_path / "none")}}).count() == 0
    io.write_annotated(spark.createDataFrame([(0, 'say "x"', "")], "row_idx long, source string, tag string"), str(tmp_path / "z"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "z"), header=True, escape='"').collect()] == [("0", 'say "x"', None)]
    lines = io.report_lines(spark.createDataFrame([("$KEEP", 3, 0.5)], "class string, tp long, f double"), columns=("tp", "f")).orderBy("place").collect()
    assert [r["value"] for r in lines] == ["class                         tp           f", "$KEEP                          3      0.5000"]
