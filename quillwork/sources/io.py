"""Readers and writers. Row order of files becomes an explicit row_idx."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillwork.functions.tables import forget, written
from quillwork.functions.text import has_word, let, lstrip_space, sanitize, split_fields, strip_space, tokens

EDITS = "array<struct<start:int,end:int,err_type:string,correction:string,required:string,comment:string,coder:string>>"


def with_row_idx(df: DataFrame) -> DataFrame:
    """df, read from files, with row_idx: 0, 1, ... in the order of file names and of rows within them.

    Rows of a file split are consecutive, so a row's number is its place in the split plus the sizes of the splits before: one
    count by split and a join with that small table; nothing is sorted or gathered.
    """
    at = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from")).withColumn("_id", F.monotonically_increasing_id())
    splits = at.groupBy("_file", "_from").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy("_file", "_from").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    splits = splits.select("_file", "_from", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return at.join(F.broadcast(splits), ["_file", "_from"]).withColumn("row_idx", F.col("_before") + F.col("_id") - F.col("_first")).drop("_file", "_from", "_id", "_n", "_first", "_before")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """row_idx, value."""
    return with_row_idx(spark.read.text(path))


def read_parallel(spark: SparkSession, source: str, *targets: str) -> DataFrame:
    """row_idx, source, target_0, ... of line-aligned files; up to the shortest, without rows whose source is blank."""
    out = read_lines(spark, source).withColumnRenamed("value", "source")
    for k, t in enumerate(targets):
        out = out.join(read_lines(spark, t).withColumnRenamed("value", f"target_{k}"), "row_idx")
    return out.where(strip_space(F.col("source")) != "").select("row_idx", "source", *[f"target_{k}" for k in range(len(targets))])


def read_pairs_csv(spark: SparkSession, path: str, **extra: str) -> DataFrame:
    """row_idx, source, target and the constants `extra` of a CSV file; rows without source or target are dropped. An index column
    is ignored; a file without the two columns is an error."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if not {"source", "target"} <= set(df.columns):
        raise ValueError(f"{path}: columns source and target are needed")
    out = with_row_idx(df).select("row_idx", "source", "target").na.drop(subset=["source", "target"])
    return out.withColumns({k: F.lit(v) for k, v in extra.items()})


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_registry(spark: SparkSession, registry: dict[str, dict[str, str]]) -> DataFrame:
    """All pair files of {dataset: {split: path}}, with dataset and split. Files that are missing or lack the two columns are skipped;
    none at all gives an empty table."""
    out = spark.createDataFrame([], "row_idx long, source string, target string, dataset string, split string")
    for d, splits in registry.items():
        for s, path in splits.items():
            if exists(spark, path):
                try:
                    out = out.unionByName(read_pairs_csv(spark, path, dataset=d, split=s))
                except ValueError:
                    continue
    return out


def split_ordinal(df: DataFrame, order: str = "row_idx") -> DataFrame:
    """df with split: the first int(n * 0.7) rows train, the next int(n * 0.2) val, the rest test (in doubles, truncated)."""
    n = df.agg(F.count("*").alias("_n"))
    train, val = (F.col("_n") * F.lit(0.7)).cast("int"), (F.col("_n") * F.lit(0.2)).cast("int")
    return df.crossJoin(F.broadcast(n)).withColumn("split", F.when(F.col(order) < train, "train").when(F.col(order) < train + val, "val").otherwise("test")).drop("_n")  # one row


def slice_rows(df: DataFrame, start: int, end: int, order: str = "row_idx") -> DataFrame:
    """Rows start..end-1, numbered anew."""
    return df.where((F.col(order) >= start) & (F.col(order) < end)).withColumn(order, F.col(order) - start)


# ---- annotated edits (M2) ----


def parse_m2(block: Column) -> Column:
    """struct<source, tokens, edits> of a block that begins with S; else null."""

    def parsed(lines: Column) -> Column:
        source = _m2_source(lines)
        return F.when(F.element_at(lines, 1).startswith("S "), F.struct(source.alias("source"), tokens(source).alias("tokens"), _m2_edits(lines).alias("edits")))

    return let(_m2_lines(block), parsed)


def _m2_lines(block: Column) -> Column:
    return F.split(strip_space(block), "\n")


def _m2_source(lines: Column) -> Column:
    return strip_space(F.substr(F.element_at(lines, 1), F.lit(3)))


def _m2_edits(lines: Column) -> Column:
    parts = F.filter(F.transform(F.filter(lines, lambda x: x.startswith("A ")), split_fields), lambda p: F.size(p) >= 3)
    placed = F.filter(F.transform(parts, lambda p: F.struct(p.alias("p"), tokens(F.substr(p[0], F.lit(3))).alias("at"))), lambda x: F.size(x["at"]) >= 2)

    def one(x: Column) -> Column:
        p, at = x["p"], x["at"]
        get = lambda i: strip_space(F.coalesce(F.try_element_at(p, F.lit(i)), F.lit("")))
        return F.struct(at[0].cast("int").alias("start"), at[1].cast("int").alias("end"), get(2).alias("err_type"), get(3).alias("correction"), get(4).alias("required"), get(5).alias("comment"), get(6).alias("coder"))

    return F.transform(placed, one).cast(EDITS)


def read_m2(spark: SparkSession, path: str) -> DataFrame:
    """sent_id, source, tokens, edits for each block; empty or malformed blocks are left out, but keep their number. Each is made by itself,
    so that one not asked for isn't made, and the blocks left out are told by how they begin."""
    blocks = _m2_parts(with_row_idx(_m2_file(spark, path)), "row_idx")
    return blocks.select(F.col("row_idx").alias("sent_id"), "source", tokens(F.col("source")).alias("tokens"), "edits")


def _m2_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n\n").text(path)


def _m2_parts(raw: DataFrame, *keys: str) -> DataFrame:
    """keys, source, edits of raw's blocks (value)."""
    blocks = raw.where(_begins(F.col("value"))).select(*keys, _m2_lines(F.col("value")).alias("_lines"))
    return blocks.select(*keys, _m2_source(F.col("_lines")).alias("source"), _m2_edits(F.col("_lines")).alias("edits"))


def _begins(block: Column) -> Column:
    """Whether the block, stripped, begins with S and a space."""
    rest = lstrip_space(block)
    return rest.startswith("S ") & has_word(F.substr(rest, F.lit(3)))


def m2_text(source: Column, edits: Column) -> Column:
    """The lines of a block."""
    line = lambda e: F.concat(F.lit("A "), e["start"], F.lit(" "), e["end"], F.lit("|||"), F.concat_ws("|||", e["err_type"], e["correction"], F.coalesce(e["required"], F.lit("REQUIRED")), F.coalesce(e["comment"], F.lit("-NONE-")), e["coder"]))
    return F.concat_ws("\n", F.concat(F.lit("S "), source), F.transform(edits, line))


def write_m2(blocks: DataFrame, path: str, mode: str = "error", compression: str = "none") -> None:
    """blocks (sent_id, source, edits), in order across the part files."""
    lines = written(blocks.select("sent_id", m2_text(F.col("source"), F.col("edits")).alias("value")), "m2-lines")  # ranges are found by a pass of their own
    out = lines.repartitionByRange("sent_id").sortWithinPartitions("sent_id").select("value")
    out.write.mode(mode).option("lineSep", "\n\n").text(path, compression=compression)
    forget(lines)


def merge_m2(spark: SparkSession, paths: list[str], path: str, mode: str = "error", compression: str = "none") -> None:
    """The blocks of several files or folders, in the order of paths, as one; mode "append" adds them to what is there.

    A split of a file holds its blocks in order, so that it becomes a file of its own, named by its place: no block is moved between tasks.
    """
    begin = lambda: spark.createDataFrame([], "value string").write.mode(mode).text(path)
    early = mode in ("error", "errorifexists", "ignore", "default")
    if mode == "ignore" and exists(spark, path):
        return
    if early:
        begin()
    every = None
    for k, p in enumerate(paths):
        own = _m2_file(spark, p).select("value", F.lit(k).alias("_path"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"))
        every = own if every is None else every.unionByName(own)
    splits = every.groupBy("_path", "_file", "_from").agg(F.lit(1).alias("_one"))
    splits = splits.select("_path", "_file", "_from", F.format_string("%010d", F.row_number().over(Window.orderBy("_path", "_file", "_from"))).alias("_split"))  # a row for each split
    at = every.withColumn("_id", F.monotonically_increasing_id()).join(F.broadcast(splits), ["_path", "_file", "_from"])
    lines = _m2_parts(at, "_split", "_id").select("_split", "_id", m2_text(F.col("source"), F.col("edits")).alias("value"))
    out = lines.sortWithinPartitions("_split", "_id").select("_split", "value")
    folder = f"{path.rstrip('/')}-merged-{uuid.uuid4().hex}"  # beside path, which may be read, and on its file system
    out.write.partitionBy("_split").option("lineSep", "\n\n").text(folder, compression=compression)
    if not early:
        begin()
    new = spark._jvm.org.apache.hadoop.fs.Path
    there = new(folder)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    for of in fs.globStatus(new(f"{folder}/_split=*/part-*")) or []:
        at_ = of.getPath()
        if not fs.rename(at_, new(path, f"part-{at_.getParent().getName().split('=')[1]}-{at_.getName()}")):
            raise OSError(f"{at_} could not be moved to {path}")
    fs.delete(there, True)


def write_combined(pairs: DataFrame, source_path: str, target_path: str, order: tuple[str, ...] = ("dataset", "row_idx"), mode: str = "error") -> None:
    """The sources and the targets of all datasets as two line-aligned texts, in the order given."""
    for column, path in (("source", source_path), ("target", target_path)):
        line = strip_space(F.regexp_replace(F.col(column), r"[\r\n]+", " "))
        pairs.repartitionByRange(*order).sortWithinPartitions(*order).select(line.alias("value")).write.mode(mode).text(path)


def write_annotated(df: DataFrame, path: str, mode: str = "error") -> None:
    """The full table with a header; an index column is row_idx if it is there."""
    df.write.mode(mode).csv(path, header=True, escape='"', emptyValue="")


def report_lines(scores: DataFrame, name: str = "class", columns: tuple[str, ...] = ("tp", "fp", "fn", "prec", "rec", "f")) -> DataFrame:
    """place, value: an aligned text of scores, a row each by name, under a header; write.text makes it a file."""
    head = f"{name:<20}" + "".join(f"{c:>12}" for c in columns)
    cells = [F.lpad(F.format_string("%.4f", F.col(c).cast("double")) if dict(scores.dtypes)[c] == "double" else F.col(c).cast("string"), 12, " ") for c in columns]
    rows = scores.select(F.col(name).alias("place"), F.concat(F.rpad(F.col(name), 20, " "), *cells).alias("value"))
    return scores.sparkSession.createDataFrame([("", head)], "place string, value string").unionByName(rows)


def flat_edits(blocks: DataFrame) -> DataFrame:
    """sent_id, source, start_tok, end_tok, err_type, correction; a no-op becomes (-1, -1, correct, '')."""
    e = blocks.select("sent_id", "source", F.posexplode_outer("edits").alias("edit_idx", "e")).where("edit_idx is not null")  # not outer, a filter would make edits twice
    noop = F.col("e.err_type") == "noop"
    return e.select("sent_id", "edit_idx", "source", F.when(noop, -1).otherwise(F.col("e.start")).alias("start_tok"), F.when(noop, -1).otherwise(F.col("e.end")).alias("end_tok"), F.when(noop, "correct").otherwise(F.col("e.err_type")).alias("err_type"), F.when(noop, "").otherwise(F.col("e.correction")).alias("correction"))


def per_coder(blocks: DataFrame) -> DataFrame:
    """sent_id, tokens, coder, corrected, edits (with c_start, c_end): each coder's edits applied to the tokens from left to right with a
    running offset. noop and uncorrected (Um) edits get (-1, -1)."""
    e = blocks.select("sent_id", "tokens", F.explode("edits").alias("e"))
    by = e.groupBy("sent_id", "e.coder").agg(F.first("tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct("e.start", "e.end", "e.err_type", "e.correction"))).alias("edits"))
    kind = "struct<toks:array<string>,offset:int,done:array<struct<start:int,end:int,err_type:string,correction:string,c_start:int,c_end:int>>>"
    start = F.struct(F.col("tokens").alias("toks"), F.lit(0).alias("offset"), F.array().alias("done")).cast(kind)
    empty = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        skip = x["err_type"].isin("noop", "Um")
        new = tokens(x["correction"])
        at, size = x["start"] + acc["offset"], F.size(acc["toks"])
        cut = x["end"] - x["start"]
        left = F.when(at > 0, F.slice(acc["toks"], 1, F.greatest(at, F.lit(0)))).otherwise(empty)
        right = F.when(size > at + cut, F.slice(acc["toks"], F.greatest(at + cut + 1, F.lit(1)), size)).otherwise(empty)
        done = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["err_type"].alias("err_type"), x["correction"].alias("correction"), F.when(skip, -1).otherwise(at).alias("c_start"), F.when(skip, -1).otherwise(at + F.size(new)).alias("c_end"))
        return F.struct(F.when(skip, acc["toks"]).otherwise(F.concat(left, new, right)).alias("toks"), F.when(skip, acc["offset"]).otherwise(acc["offset"] + F.size(new) - cut).alias("offset"), F.concat(acc["done"], F.array(done)).alias("done")).cast(kind)

    out = by.withColumn("r", F.aggregate("edits", start, step))
    return out.select("sent_id", "coder", "tokens", F.col("r.toks").alias("corrected"), F.col("r.done").alias("edits"))


# ---- token sequences, vocabularies, lexica ----


def write_lines(df: DataFrame, column: str, path: str, order: str = "row_idx", mode: str = "error") -> None:
    """One stripped line a row, in order; line breaks inside become spaces."""
    line = strip_space(F.regexp_replace(F.col(column), r"[\r\n]+", " "))
    df.repartitionByRange(order).sortWithinPartitions(order).select(line.alias("value")).write.mode(mode).text(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """tokens, tags, source, target (and dataset if there) as JSON lines."""
    cols = [c for c in ("tokens", "tags", "source", "target", "dataset") if c in df.columns]
    df.select(*cols).write.mode(mode).json(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with tokens, source and target sanitised."""
    df = spark.read.schema("tokens array<string>, tags array<string>, source string, target string, dataset string").json(path)
    return df.withColumn("tokens", F.transform("tokens", sanitize)).withColumn("source", sanitize(F.col("source"))).withColumn("target", sanitize(F.col("target")))


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """tag, id from a JSON file {vocab: [...]}."""
    return spark.read.schema("vocab array<string>").json(path, multiLine=True).select(F.posexplode("vocab").alias("id", "tag")).select("tag", "id")


def vocab_json(vocab: DataFrame) -> str:
    """The JSON text {vocab, tag2id, id2tag} of a vocabulary (tag, id)."""
    rows = sorted((r["id"], r["tag"]) for r in vocab.collect())  # the tag classes
    return json.dumps({"vocab": [t for _, t in rows], "tag2id": {t: i for i, t in rows}, "id2tag": {str(i): t for i, t in rows}}, ensure_ascii=False)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """row_idx, form, lemma, msd of a (gzipped) file of tab-separated lines; lines without exactly three fields are left out."""
    lines = read_lines(spark, path).withColumn("p", F.split(strip_space(F.col("value")), "\t", -1)).where(F.size("p") == 3)
    return lines.select("row_idx", F.col("p")[0].alias("form"), F.col("p")[1].alias("lemma"), F.col("p")[2].alias("msd"))


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.explode(tokens(F.col("value"))).alias("word")).distinct()


def read_tag_map(spark: SparkSession, path: str) -> DataFrame:
    """ptb, upos."""
    return spark.read.csv(path, sep="\t", schema="ptb string, upos string").where("upos is not null").withColumn("upos", F.trim("upos"))


# ---- images, features, models ----


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """path, content of .jpg, .jpeg, .png and PNM files, whatever the case."""
    return spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.(jpe?g|png|p[bgnp]m)$")).select("path", "content")


def write_features(df: DataFrame, path: str, mode: str = "error") -> None:
    df.orderBy("image").write.mode(mode).csv(path, header=True, emptyValue="", nullValue="")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    names = ("S_ref", "theta_deg", "S_per_x", "per_x_lag", "S_per_y", "per_y_lag", "edge_density", "anisotropy", "H", "W")
    df = spark.read.csv(path, header=True)
    return df.select("image", *[F.col(n).cast("float").alias(n) for n in names if n in df.columns])


def write_assignments(df: DataFrame, path: str, mode: str = "error") -> None:
    df.select(F.col("id").alias("image"), "cluster", "cluster_name", "confidence", "reason").write.mode(mode).csv(path, header=True)


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="image string, cluster int, cluster_name string, confidence double, reason string")


def save_model(spark: SparkSession, model: dict, path: str, mode: str = "error") -> None:
    """A cluster model as a one-row Parquet table."""
    spark.createDataFrame([(json.dumps(model),)], "model string").write.mode(mode).parquet(path)


def load_model(spark: SparkSession, path: str) -> dict:
    model = json.loads(spark.read.parquet(path).first()["model"])
    return model | {"centers": {int(k): v for k, v in model["centers"].items()}, "names": {int(k): tuple(v) for k, v in model["names"].items()}}
