"""Queries of sources, sinks and smaller operators: tables written and read back, with the SQL of what must come out."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.functions import text as X
from quillwork.operators import align, loop, tags
from quillwork.sources import io

from .derived import EDITS_SQL, TOKENS_SQL, derived_edits, table


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; with a local master and none set, in a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillwork-")
    return f"{found.rstrip('/')}/quillwork/{name}-{uuid.uuid4().hex}"


def _blocks(spark, sf_dir) -> DataFrame:
    e = derived_edits(spark, sf_dir, some=True)
    own = F.transform("edits", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["err_type"].alias("err_type"), F.translate(x["correction"], "|", "/").alias("correction"), F.lit("REQUIRED").alias("required"), F.lit("-NONE-").alias("comment"), F.lit("0").alias("coder")))
    return e.select(F.col("doc_id").alias("sent_id"), F.array_join("toks", " ").alias("source"), own.alias("edits"))


def _flat(blocks: DataFrame) -> DataFrame:
    return io.flat_edits(blocks).select(F.col("sent_id").cast("long").alias("sent_id"), F.col("edit_idx").cast("long").alias("edit_idx"), F.col("start_tok").cast("long").alias("start_tok"), F.col("end_tok").cast("long").alias("end_tok"), "err_type", "correction")


def m2_roundtrip(spark, sf_dir):
    path = scratch(spark, "m2")
    io.write_m2(_blocks(spark, sf_dir), path)
    return _flat(io.read_m2(spark, path))


_M2 = f"""WITH {TOKENS_SQL}, {EDITS_SQL}, s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS sent_id, count(*) OVER () AS every FROM t WHERE len(toks) > 0),
r AS (SELECT sent_id, every, row_number() OVER (PARTITION BY doc_id ORDER BY "start") - 1 AS edit_idx, "start"::BIGINT AS start_tok, "end"::BIGINT AS end_tok, err_type, replace(correction, '|', '/') AS correction FROM e JOIN s USING (doc_id))"""


def m2_merged(spark, sf_dir):
    first, out = scratch(spark, "m2"), scratch(spark, "m2-merged")
    io.write_m2(_blocks(spark, sf_dir), first, compression="gzip")
    io.merge_m2(spark, [first, first], out, compression="gzip")
    return _flat(io.read_m2(spark, out))


def _part(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 10 > 0, F.col("p_type")).alias("p_type"))


def csv_registry(spark, sf_dir):
    """Two pair files, one without rows of some targets; a missing file and one without the columns are skipped."""
    p, where = _part(spark, sf_dir), {}
    for k, name in enumerate(("even", "odd")):
        where[name] = scratch(spark, f"csv-{name}")
        own = p.where(F.col("p_partkey") % 2 == k).repartition(1).sortWithinPartitions("p_partkey")
        own.select(F.col("p_name").alias("source"), F.col("p_type").alias("target")).write.csv(where[name], header=True)
    where["other"] = scratch(spark, "csv-other")
    p.limit(3).select("p_name").write.csv(where["other"], header=True)
    registry = {name: {"train": path} for name, path in where.items()} | {"missing": {"test": where["even"] + "-none"}}
    return io.read_registry(spark, registry).select("dataset", "split", "row_idx", "source", "target")


def parallel_lines(spark, sf_dir):
    p = _part(spark, sf_dir).select(F.col("p_partkey").alias("row_idx"), F.lit("one").alias("dataset"), F.when(F.col("p_partkey") % 7 == 0, " ").otherwise(F.concat(F.lit(" "), "p_name")).alias("source"), F.coalesce("p_type", F.lit("none")).alias("target"))
    a, b = scratch(spark, "lines"), scratch(spark, "lines")
    io.write_combined(p, a, b)
    return io.read_parallel(spark, a, b)


def jsonl_roundtrip(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    c = c.select(F.translate("text", "s", "ş").alias("source"), F.col("text").alias("target"), F.concat_ws("-", "conv_id", "turn").alias("dataset"))
    c = c.withColumn("tokens", X.tokens(F.col("source"))).withColumn("tags", F.transform("tokens", lambda t: F.lit("$KEEP")))
    path = scratch(spark, "jsonl")
    io.write_jsonl(c, path)
    md5 = lambda c: F.md5(F.coalesce(c, F.lit("")).cast("binary"))
    return io.read_jsonl(spark, path).select("dataset", md5(F.array_join("tokens", " ")).alias("tokens_md5"), md5(F.col("source")).alias("source_md5"), md5(F.col("target")).alias("target_md5"), F.size("tags").cast("long").alias("n_tags"))


def vocab_ids(spark, sf_dir):
    path = scratch(spark, "vocab")
    v = tags.vocabulary(table(spark, sf_dir, "part").select(F.concat(F.lit("$REPLACE_"), "p_brand").alias("tag")))
    spark.createDataFrame([(io.vocab_json(v),)], "value string").write.text(path)
    return io.read_vocab(spark, path).select("tag", F.col("id").cast("long").alias("id"))


def lexicon_scan(spark, sf_dir):
    p, path = _part(spark, sf_dir), scratch(spark, "lexicon")
    line = F.when(F.col("p_partkey") % 7 == 0, F.concat_ws("\t", "p_name", F.lit("short"))).otherwise(F.concat_ws("\t", "p_name", F.lower("p_name"), F.coalesce("p_type", F.lit("V"))))
    p.withColumn("line", line).repartition(1).sortWithinPartitions("p_partkey").select(F.col("line").alias("value")).write.text(path, compression="gzip")
    return io.read_lexicon(spark, path)


def word_list_scan(spark, sf_dir):
    path = scratch(spark, "words")
    table(spark, sf_dir, "part").select(F.col("p_type").alias("value")).write.text(path)
    return io.read_word_list(spark, path)


def features_roundtrip(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    e = e.select(F.concat(F.lit("img"), "vec_id").alias("image"), F.when(F.col("vec_id") % 9 > 0, F.col("embedding")[0]).alias("S_ref"), F.col("embedding")[1].alias("anisotropy"))
    path = scratch(spark, "features")
    io.write_features(e, path)
    return io.read_features(spark, path).select("image", F.round(F.col("S_ref").cast("double"), 5).alias("s_ref"), F.round(F.col("anisotropy").cast("double"), 5).alias("anisotropy"))


def assignments_roundtrip(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("img"), "vec_id").alias("id"), F.col("label").cast("int").alias("cluster"), F.lit("name").alias("cluster_name"), (F.col("vec_id") % 100 / 100).alias("confidence"), F.lit("high x, low y").alias("reason"))
    path = scratch(spark, "assignments")
    io.write_assignments(e, path)
    return io.read_assignments(spark, path).select("image", F.col("cluster").cast("long").alias("cluster"), "cluster_name", "confidence", "reason")


def model_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "region").orderBy("r_regionkey").collect()  # five regions
    path = scratch(spark, "model")
    io.save_model(spark, {"centers": {int(r["r_regionkey"]): [float(r["r_regionkey"]), 0.5] for r in rows}, "names": {int(r["r_regionkey"]): (r["r_name"], "why") for r in rows}, "space": "zscore"}, path)
    m = io.load_model(spark, path)
    return spark.createDataFrame([(k, v[0], v[1], *m["names"][k], m["space"]) for k, v in m["centers"].items()], "cluster long, x double, y double, name string, reason string, space string")


def first_piece_labels(spark, sf_dir):
    """Words of 1 to 3 pieces between two special ones; the tags end one word early."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.tokens(F.col("text")).alias("toks"))
    ids = F.flatten(F.transform("toks", lambda t, i: F.array_repeat(i, F.length(t) % 3 + 1)))
    none = F.array(F.lit(None).cast("int"))
    c = c.select("conv_id", "turn", F.concat(none, ids, none).alias("word_ids"), F.transform(F.slice("toks", 1, F.greatest(F.size("toks") - 1, F.lit(0))), lambda t: F.concat(F.lit("$T"), F.length(t))).alias("tags"))
    return loop.first_piece_labels(c).select("conv_id", "turn", F.md5(F.array_join("labels", ",", "_").cast("binary")).alias("labels_md5"))


def minimised_edits(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_type", " ").alias("o"))
    p = p.withColumn("c", F.filter(F.transform("o", lambda w, i: F.when((F.col("p_partkey") + i) % 3 == 0, F.when(F.col("p_partkey") % 2 == 0, F.lower(w))).otherwise(w)), lambda w: w.isNotNull()))
    m = align.minimise(F.col("o"), F.col("c"), F.lit(10), F.lit(10) + F.size("o"))
    return p.select("p_partkey", m.alias("m")).select("p_partkey", F.col("m.start").cast("long").alias("start"), F.col("m.end").cast("long").alias("end"), "m.cor")


def word_predicates(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"))).alias("w")).distinct()
    name = F.concat(F.lit("/a/b/"), "w", F.lit(".PNG"))
    return w.select("w", X.is_alpha(F.col("w")).alias("alpha"), X.is_punct_token(F.col("w")).alias("punct"), F.size(X.split_fields(F.concat("w", F.lit("|||"), "w", F.lit("||||||")))).cast("long").alias("fields"), X.basename(name).alias("base"), X.extension(name).alias("ext"))


def class_losses(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("batch"), F.slice("embedding", 1, 4).cast("array<double>").alias("logits"), F.when(F.col("vec_id") % 5 > 0, F.col("vec_id") % 4).cast("int").alias("label"))
    return loop.weighted_loss(e, [1.0, 2.0, 0.5, 1.5]).select("batch", "n", F.round("loss", 6).alias("loss"))


def epoch_loss(spark, sf_dir):
    b = class_losses(spark, sf_dir).select((F.col("batch") % 3).alias("epoch"), "loss")
    return loop.epoch_losses(b).select("epoch", F.round("mean_loss", 5).alias("mean_loss"))


def tags_by_source(spark, sf_dir):
    """The edits of documents with equal words on one tag array, in the order of documents and places."""
    def tagged(e):
        tag = tags.full_tag(tags.base_for(e["err_type"], tags.GENERATION_A), e["correction"], False)
        return F.struct((F.col("doc_id") * 1000000 + e["start"]).alias("row_idx"), e["start"].alias("start"), e["end"].alias("end"), tag.alias("tag"))

    e = derived_edits(spark, sf_dir).select("doc_id", F.array_join("toks", " ").alias("source"), F.transform("edits", tagged).alias("e"))
    out = tags.sequences_by_text(e.where(F.size("e") > 0).select("source", "e", F.get("e", F.lit(0))["row_idx"].alias("row_idx"), F.concat(F.lit("t"), "doc_id").alias("target"), F.lit("d").alias("dataset")))
    return out.select(F.md5(F.col("source").cast("binary")).alias("source_md5"), "target", "dataset", F.md5(F.array_join("tags", "\n").cast("binary")).alias("tags_md5"))


def head_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_idx"), "p_name")
    return io.slice_rows(p, 0, 50)


_C = r"c AS (SELECT conv_id, turn, text, list_filter(string_split_regex(text, '[\t-\r ]+'), lambda x: x <> '') AS toks FROM conversations)"
_PUNCT = X.ASCII_PUNCT.replace("'", "''")
ORACLES = {
    "m2_roundtrip": f"{_M2} SELECT sent_id, edit_idx, start_tok, end_tok, err_type, correction FROM r",
    "m2_merged": f"{_M2} SELECT sent_id + k * every AS sent_id, edit_idx, start_tok, end_tok, err_type, correction FROM r, (VALUES (0), (1)) AS v(k)",
    "csv_registry": "SELECT * FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, 'train' AS split, row_number() OVER (PARTITION BY p_partkey % 2 ORDER BY p_partkey) - 1 AS row_idx, p_name AS source, CASE WHEN p_partkey % 10 > 0 THEN p_type END AS target FROM part) WHERE target IS NOT NULL",
    "parallel_lines": "SELECT row_idx, source, target_0 FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_idx, p_name AS source, CASE WHEN p_partkey % 10 > 0 THEN p_type ELSE 'none' END AS target_0, p_partkey FROM part) WHERE p_partkey % 7 > 0",
    "jsonl_roundtrip": f"WITH {_C} SELECT conv_id || '-' || turn AS dataset, md5(replace(array_to_string(toks, ' '), 's', 'ș')) AS tokens_md5, md5(replace(text, 's', 'ș')) AS source_md5, md5(text) AS target_md5, len(toks)::BIGINT AS n_tags FROM c",
    "vocab_ids": "SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS id FROM (SELECT DISTINCT '$REPLACE_' || p_brand AS tag FROM part)",
    "lexicon_scan": "SELECT row_idx, p_name AS form, lower(p_name) AS lemma, CASE WHEN p_partkey % 10 > 0 THEN p_type ELSE 'V' END AS msd FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS row_idx FROM part) WHERE p_partkey % 7 > 0",
    "word_list_scan": "SELECT DISTINCT unnest(string_split(p_type, ' ')) AS word FROM part",
    "features_roundtrip": "SELECT 'img' || vec_id AS image, CASE WHEN vec_id % 9 > 0 THEN round(embedding[1]::DOUBLE, 5) END AS s_ref, round(embedding[2]::DOUBLE, 5) AS anisotropy FROM embeddings",
    "assignments_roundtrip": "SELECT 'img' || vec_id AS image, label::BIGINT AS cluster, 'name' AS cluster_name, (vec_id % 100) / 100 AS confidence, 'high x, low y' AS reason FROM embeddings",
    "model_roundtrip": "SELECT r_regionkey::BIGINT AS cluster, r_regionkey::DOUBLE AS x, 0.5::DOUBLE AS y, r_name AS name, 'why' AS reason, 'zscore' AS space FROM region",
    "first_piece_labels": f"WITH {_C} SELECT conv_id, turn, md5('_,' || CASE WHEN len(toks) > 0 THEN array_to_string(list_transform(toks, lambda t, i: CASE WHEN i < len(toks) THEN '$T' || length(t) ELSE '$KEEP' END || repeat(',_', length(t) % 3)), ',') || ',' ELSE '' END || '_') AS labels_md5 FROM c",
    "minimised_edits": """WITH p AS (SELECT p_partkey, string_split(p_type, ' ') AS o FROM part),
q AS (SELECT p_partkey, o, list_filter(list_transform(o, lambda w, i: CASE WHEN (p_partkey + i - 1) % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN lower(w) END ELSE w END), lambda w: w IS NOT NULL) AS c FROM p),
r AS (SELECT *, least(len(o), len(c)) AS n FROM q), h AS (SELECT *, coalesce(list_min(list_filter(range(1, n + 1), lambda i: o[i] <> c[i])) - 1, n) AS head FROM r),
t AS (SELECT *, coalesce(list_min(list_filter(range(1, n - head + 1), lambda i: o[len(o) - i + 1] <> c[len(c) - i + 1])) - 1, n - head) AS tail FROM h)
SELECT p_partkey, 10 + head AS "start", 10 + len(o) - tail AS "end", array_to_string(c[head + 1 : len(c) - tail], ' ') AS cor FROM t""",
    "word_predicates": f"WITH {TOKENS_SQL} SELECT w, regexp_full_match(w, '\\p{{L}}+') AS alpha, contains('{_PUNCT}', w) AS punct, len(string_split(w || '|||' || w || '||||||', '|||'))::BIGINT AS fields, list_extract(string_split('/a/b/' || w || '.PNG', '/'), -1) AS base, '.png' AS ext FROM (SELECT DISTINCT unnest(toks) AS w FROM t)",
    "class_losses": """WITH e AS (SELECT vec_id // 64 AS batch, list_transform(embedding[1:4], lambda x: x::DOUBLE) AS l, CASE WHEN vec_id % 5 > 0 THEN vec_id % 4 END AS y FROM embeddings),
w AS (SELECT batch, [1.0, 2.0, 0.5, 1.5][y + 1]::DOUBLE AS w, ln(list_sum(list_transform(l, lambda x: exp(x)))) - l[y + 1] AS nll FROM e) SELECT batch, count(w) AS n, round(sum(w * nll) / sum(w), 6) AS loss FROM w GROUP BY batch""",
    "head_rows": "SELECT p_partkey AS row_idx, p_name FROM part WHERE p_partkey >= 0 AND p_partkey < 50",
}
ORACLES["epoch_loss"] = f"SELECT batch % 3 AS epoch, round(avg(loss), 5) AS mean_loss FROM ({ORACLES['class_losses']}) GROUP BY ALL"
QUERIES = {f.__name__: f for f in (
    m2_roundtrip, m2_merged, csv_registry, parallel_lines, jsonl_roundtrip, vocab_ids, lexicon_scan, word_list_scan, features_roundtrip, assignments_roundtrip, model_roundtrip,
    first_piece_labels, minimised_edits, word_predicates, class_losses, epoch_loss, tags_by_source, head_rows,
)}
