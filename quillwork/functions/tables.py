"""Tables written in the folder that the cluster shares, so that a plan ends there and a lost executor costs nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Unset, a local master (as in tests) gets a temporary folder and a cluster an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="quillwork-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of the shared folder, written once and read from there."""
    path = f"{shared_dir(df.sparkSession)}/quillwork/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quillwork_path = path
    return out


def dealt(df: DataFrame, tasks: int = 4) -> DataFrame:
    """df dealt evenly to `tasks` tasks a core, before a step that costs far more than moving a row: partitions are made by bytes, which
    may put all rows of such a step into one."""
    return df.repartition(tasks * df.sparkSession.sparkContext.defaultParallelism)


def forget(df: DataFrame) -> None:
    """Delete a written() table that nothing reads any more."""
    path = getattr(df, "_quillwork_path", None)
    if path:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def numbered(df: DataFrame, order: list, name: str, number: str = "rank") -> DataFrame:
    """df with `number`, counting its rows from 0 in the order given, without a global window: rows are sorted over ranges and written
    once with their place in their range; the sizes of the ranges, a number each, come from that table and not from another sort."""
    from pyspark.sql import functions as F

    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before, total = [], 0
    for p, n in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        before.append((p, total))
        total += n
    offsets = F.create_map(*[F.lit(x) for pair in before for x in pair]) if before else F.lit(None).cast("map<bigint,bigint>")
    out = placed.withColumn(number, F.element_at(offsets, part) + place).drop("_at")
    out._quillwork_rows = total
    return out
