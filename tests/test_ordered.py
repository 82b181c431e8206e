"""Operators that hang on a row order, held against plain loops over many partitions."""

import random

import pytest
from pyspark.sql import functions as F

from quillwork.functions import tables, twister
from quillwork.operators import score, tags


@pytest.fixture
def wide(spark):
    """Sixteen partitions a shuffle, none put together again."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("draws", [0, 1, 2, 311, 312, 313, 100_003])
def test_twister_from_any_place(draws):
    for seed in (0, 42, 2**70 + 1):
        rng = random.Random(seed)
        for _ in range(draws):
            rng.random()
        own = twister.generator(seed, draws)
        assert [own.random() for _ in range(1500)] == [rng.random() for _ in range(1500)]


def test_twister_far_away():
    near, far = twister.generator(7, 10**13), twister.generator(7, 10**13 + 9)
    for _ in range(9):
        near.random()
    assert [near.random() for _ in range(700)] == [far.random() for _ in range(700)]


def test_numbered(wide):
    df = wide.range(5000, numPartitions=7).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(10**9)))
    got = sorted((r["k"], r["rank"]) for r in tables.numbered(df, [F.col("k")], "t").collect())
    assert [x[1] for x in got] == list(range(5000))
    assert tables.numbered(df.limit(0), [F.col("k")], "t").count() == 0


def test_clean_sample_over_partitions(wide):
    n = 300_000
    df = wide.range(n, numPartitions=5).select(((F.col("id") * 7919) % n).alias("sent_id"), F.when(F.col("id") % 11 == 3, F.array(F.lit("$DELETE"))).otherwise(F.array(F.lit("$KEEP"), F.lit("$KEEP"))).alias("tags"))
    clean = sorted(r[0] for r in df.where(tags.all_keep(F.col("tags"))).select("sent_id").collect())
    rng = random.Random(42)
    want = sorted([i for i in clean if rng.random() <= 0.1] + list(set(range(n)) - set(clean)))
    assert sorted(r[0] for r in tags.sample_clean(df).select("sent_id").collect()) == want


def test_clean_sample_query(wide):
    """The query over the whole table of sf0.001 against draws in the order of doc_id."""
    from quillwork.plans import catalogue
    from quillwork.plans.derived import derived_edits

    sf = "/root/testdata/sf0.001"
    rows = derived_edits(wide, sf).select("doc_id", F.size("toks").alias("n"), tags.all_keep(tags.edits_to_tags(F.col("toks"), F.col("edits"))).alias("clean")).collect()
    rng = random.Random(42)
    want = [(r["doc_id"], r["n"]) for r in sorted(rows) if not r["clean"] or rng.random() <= 0.1]
    assert sorted((r["sent_id"], r["n"]) for r in catalogue.clean_sample(wide, sf).collect()) == want


def fold(rows, beta=0.5):
    """rows: {sent: [(coder, tp, fp, fn)]}."""
    total, out = [0, 0, 0], {}
    for sent in sorted(rows):
        best = None
        for coder, *own in rows[sent]:
            key = (score._f_score(*[a + b for a, b in zip(own, total)], beta), own[0], -own[1], -own[2])
            if best is None or key > best[0]:
                best = (key, coder, own)
        total = [a + b for a, b in zip(total, best[2])]
        out[sent] = best[1]
    return out


@pytest.mark.parametrize("piece", [1, 7, 4096])
def test_best_annotator(wide, piece):
    r = random.Random(piece)
    rows = {}
    for sent in r.sample(range(10_000), 60):
        coders = r.sample(range(5), r.choice([1, 1, 2, 3]))
        rows[sent] = [(c, r.randint(0, 3), r.randint(0, 3), r.randint(0, 3)) for c in coders]
    counts = [(s, c, "R:X", *n) for s, own in rows.items() for c, *n in own if any(n)]
    sents = [(s, c, k) for s, own in rows.items() for k, (c, *_) in enumerate(own)]
    df = wide.createDataFrame(counts, "sent_id long, coder int, cat string, tp long, fp long, fn long")
    got = score.best_annotator(df, wide.createDataFrame(sents, "sent_id long, coder int, place int"), fold=piece)
    assert {x["sent_id"]: x["coder"] for x in got.collect()} == fold(rows)
