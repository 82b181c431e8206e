import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["vec_id", "cluster", "confidence"] and df.count() > 0


def rows(found, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i] for i in order)) for r in found)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not k.startswith("op") and k != "pipeline"))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t[:-8]} as select * from '{SF}/{t}'")
    r = c.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in r.description]
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert rows([tuple(x) for x in df.collect()], df.columns) == rows(r.fetchall(), cols)


@pytest.mark.parametrize("name", ["typed_edits", "best_annotator", "clean_sample", "image_features", "correction_loop", "lexicon_reclass_noise"])
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).limit(1).count() == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_image_features_search_every_degree(spark):
    theta = {round(r["theta_deg"], 3) for r in entry.queries()["image_features"](spark, SF).select("theta_deg").collect()}
    assert theta - {-15.0, 0.0, 15.0} and all(abs(t - round(t)) < 1e-3 and abs(t) <= 15 for t in theta)


def test_grey_pictures_multiplies_floats(spark, tmp_path):
    near = next(v for v in (float(np.float32(k / 400) - np.float32(d)) for k in range(1, 150) for d in (0, 1e-9, 1e-8)) if np.floor(np.float32(v) * np.float32(400)) != np.floor(v * 400))
    spark.createDataFrame([(0, [near] * 64)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = c.execute(entry.oracle_sql()["grey_pictures"]).fetchall()
    assert [tuple(r) for r in entry.queries()["grey_pictures"](spark, str(tmp_path)).collect()] == want
