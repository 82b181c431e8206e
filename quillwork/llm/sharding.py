"""Sharding by balanced label propagation: equal texts move to one shard under capacity quotas, and counts stay even."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, whole_row, without
from .prefix import running

#: Shards, and how far above its quota a shard may be filled while labels move.
SHARDS, SLACK = 16, 1.5
#: Pieces of a group's rows that are joined apart, so that no group lands in one task.
SALTS = 16
_GROUP_BUCKETS, _ROW_BUCKETS = 256, 64


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, gid (equal for equal texts) for each row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("gid"))


def _salted(groups: DataFrame) -> DataFrame:
    """A row of groups for each piece of a group."""
    return groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def cut_groups(placed: DataFrame) -> DataFrame:
    """n_groups, n_cut: groups of two rows or more in placed (gid, shard), and those of them in more than one shard."""
    groups = placed.groupBy("gid").agg(F.count("*").alias("n"), F.min("shard").alias("lo"), F.max("shard").alias("hi")).where("n > 1")
    return groups.agg(F.count("*").alias("n_groups"), F.count_if(F.col("lo") < F.col("hi")).alias("n_cut"))


def propagate(table: DataFrame, shards: int = SHARDS) -> DataFrame:
    """table (doc_id, gid, text_crc32, size, ...) with shard int: row counts at most one apart, links (equal gid) cut seldom.

    The links of a group are counted by shard, never listed. All rows start evenly by hash. In each round a linked row learns
    which shard with room holds most of its group and moves there if that is more than its own shard holds; moves into a shard
    are admitted in the order of their groups until it is full, SLACK times its quota. Rounds end when none moves (every move raises
    the sum of the squared counts of a group, so that they do end). Then the quotas are met exactly: what a shard holds above its own, the last groups in order, and the rows without a link fill the shards'
    free places one after the other, so that at most two groups a shard are cut there.
    """
    row = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    table = table.withColumn("bucket", F.pmod(F.xxhash64("gid"), F.lit(_GROUP_BUCKETS)) * _ROW_BUCKETS + F.pmod(F.xxhash64(*row), F.lit(_ROW_BUCKETS)))
    sizes = table.groupBy("gid").agg(F.count("*").alias("n")).where("n > 1").select("gid")
    start = running(table.withColumn("one", F.lit(0)).withColumn("b", F.pmod(F.xxhash64(*row), F.lit(4096))), "one", "b", [*row, F.col("gid")], F.lit(1), "rank").drop("one", "b")
    start = start.withColumn("shard", ((F.col("rank") - 1) % shards).cast("int")).drop("rank")
    start = start.withColumn("salt", F.col("bucket") % SALTS)
    now = materialize(start.join(_salted(sizes.withColumn("linked", F.lit(True))), ["gid", "salt"], "left").withColumn("linked", F.coalesce("linked", F.lit(False))), "shard-start")
    total = now.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    while True:
        held = {r["shard"]: r["n"] for r in now.where("linked").groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row a shard
        room = [int(SLACK * quota[s]) - held.get(s, 0) for s in range(shards)]
        rooms = F.array(*[F.lit(x).cast("long") for x in room])
        links = now.where("linked").groupBy("gid", "shard").agg(F.count("*").alias("n"))
        best = links.where(F.element_at(rooms, F.col("shard") + 1) > 0).groupBy("gid").agg(F.max(F.struct("n", F.pmod(F.xxhash64("gid", "shard"), F.lit(1 << 30)).alias("t"), F.col("shard").alias("to"))).alias("best"))
        plan = links.withColumnRenamed("n", "own").join(best, "gid").where((F.col("shard") != F.col("best.to")) & (F.struct(F.col("best.n"), F.col("best.t")) > F.struct(F.col("own"), F.pmod(F.xxhash64("gid", "shard"), F.lit(1 << 30)))))
        plan = plan.select("gid", "shard", F.col("best.to").alias("to"))
        moved = now.where("linked").join(_salted(plan), ["gid", "shard", "salt"], "left")
        staying = moved.where("to is null")
        movers = running(moved.where("to is not null"), "to", "bucket", [F.col("gid"), *row], F.lit(1), "rank")
        movers = movers.withColumn("go", F.col("rank") <= F.element_at(rooms, F.col("to") + 1))
        then = staying.select(*[c for c in now.columns], F.lit(False).alias("go")).unionByName(movers.select(*[F.when(F.col("go"), F.col("to")).otherwise(F.col("shard")).alias("shard") if c == "shard" else F.col(c) for c in now.columns], "go"))
        then = materialize(then.unionByName(now.where("not linked").withColumn("go", F.lit(False))), "shard-round")
        went = then.where("go").limit(1).count()
        discard(now)
        now = then.drop("go")
        now._quillwork_path = then._quillwork_path
        if not went:
            break
    held = {r["shard"]: r["n"] for r in now.where("linked").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    upto, bounds = 0, []
    for s in range(shards):
        upto += quota[s] - min(held.get(s, 0), quota[s])
        bounds.append(upto)
    columns = [c for c in now.columns if c not in ("linked", "bucket", "salt")]
    ranked = running(now.where("linked"), "shard", "bucket", [F.col("gid"), *row], F.lit(1), "rank")
    within = F.col("rank") <= F.element_at(F.array(*[F.lit(q).cast("long") for q in quota]), F.col("shard") + 1)
    ranked = materialize(ranked.withColumn("within", within).drop("rank"), "shard-ranked")
    loose = ranked.where("not within").select(*columns, F.col("bucket").alias("b"))
    alone = now.where("not linked").select(*columns, (F.pmod(F.xxhash64(*row), F.lit(4096)) + _GROUP_BUCKETS * _ROW_BUCKETS).alias("b"))
    free = running(loose.unionByName(alone).withColumn("one", F.lit(0)), "one", "b", [F.col("gid"), *row], F.lit(1), "rank")
    place = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.col("rank")))
    free = free.withColumn("shard", place.cast("int"))
    return ranked.where("within").select(columns).unionByName(free.select(columns))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs. The law is `rows`.

    slot numbers a shard's rows from 0 without gaps. Null texts are empty texts; null ids and repeated rows are rows like
    others (equal rows are linked, and any of them may have either slot); an empty table gives an empty result.
    """
    placed = materialize(propagate(nodes(docs), shards), "shard-placed")
    placed = placed.withColumn("b", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(1024)))
    out = running(placed, "shard", "b", [F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("gid")], F.lit(1), "rank")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


_ADDED = ("size", "text_crc32", "law", "shard", "slot")


def with_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows of docs with size, text_crc32, law, shard and slot, which take the place of columns of these names.

    Of rows equal in doc_id and text each gets one of their slots. Null and empty texts, null ids, repeated rows, very long texts and
    empty tables are as in sharded(). The texts are shuffled once, after the propagation, which knows their hashes only.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("bytes"), F.crc32(text.cast("binary")).alias("crc"))
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "bytes", "crc").orderBy(F.lit(0))))
    plan = sharded(docs, shards).drop("grown_shard")
    plan = plan.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "size", "text_crc32").orderBy("shard", "slot")))
    keys = own["doc_id"].eqNullSafe(plan["doc_id"]) & (own["bytes"] == plan["size"]) & (own["crc"] == plan["text_crc32"]) & (own["nth"] == plan["n"])
    return own.join(plan, keys).select(*without(docs, _ADDED), *[plan[c] for c in _ADDED])
