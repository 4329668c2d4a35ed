"""Operator 4: seeded two-pass external shuffle into shards, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED = 20_24
#: Bytes of rows of a bucket: a bucket is shuffled in memory. A task takes buckets of about so many bytes together.
BUCKET_BYTES, TASK_BYTES = 4 << 20, 64 << 20
#: Tasks of the second pass at most; beyond, each takes more buckets, one after the other.
MOST_TASKS = 50_000


def _top_shard(id_col: Column, shards: int, seed: int) -> Column:
    """Rendezvous hashing: the shard whose seeded hash with the id is largest."""
    score = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), id_col, s).alias("h"), s.alias("s")))
    return F.array_max(score)


def _bytes(row: DataFrame, columns: list[str]) -> Column:
    """About how many bytes a row has: of texts and binaries exactly, of nested columns as JSON, 8 of others."""
    total = F.lit(16).cast("long")
    for c in columns:
        kind, value = row.schema[c].dataType, F.col(f"`{c}`")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            total += F.coalesce(F.octet_length(value), F.lit(0))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            total += F.coalesce(F.octet_length(F.to_json(F.struct(value.alias("c")))), F.lit(0))
        else:
            total += 8
    return total


def shuffle_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs``, all columns, plus shard, slot (place in the shard, gapless from 0) and grown_shard.

    Pass 1 scatters: id and shard count decide the shard by rendezvous hashes, so that one more shard
    (``grown_shard``) takes rows only into itself; another seeded hash, of id and row, deals a shard's rows
    uniformly over as many buckets as keep one near ``bucket_bytes`` (all columns count), so a shard that a frequent id fills has
    more buckets. Runs of neighbouring buckets make the tasks: none is empty and none has twice its share. Pass 2 gathers each bucket as
    one array in order of id and row, shuffles it (``shuffle`` is a seeded Fisher-Yates shuffle) and lays the
    buckets of a shard end to end.

    Two runs over the same rows give the same slots: rows of a bucket are ordered before they are
    shuffled, and the buckets of a task too. Null ids are hashed like a value. Only rows that are equal in id, text and all columns
    but maps share a bucket of necessity. An empty table gives an empty result; columns named like an added one are replaced,
    and others may have any name; columns of any type pass through.
    """
    spark, added = docs.sparkSession, ("shard", "slot", "grown_shard")
    plain = [c for c in docs.columns if c not in added]
    hashed = [F.col(f"`{c}`") for c in docs.columns if not _holds_map(docs.schema[c].dataType)]
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), _bytes(docs, plain).alias("size"), F.xxhash64(F.lit(seed + 1), *hashed).alias("hash"), F.struct(*(F.col(f"`{c}`") for c in plain)).alias("row"))
    keyed = keyed.withColumn("top", _top_shard(F.col("id"), shards, seed)).withColumn("shard", F.col("top.s"))
    sizes = keyed.groupBy("shard").agg(F.sum("size").alias("size")).collect()  # a row for each shard
    by_shard = {r["shard"]: max(1, math.ceil(r["size"] / bucket_bytes)) for r in sizes}
    buckets = sum(by_shard.values())
    tasks = max(2, min(buckets, MOST_TASKS, max(math.ceil(buckets * bucket_bytes / TASK_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))))
    first, plan = 0, []
    for shard in sorted(by_shard):
        plan.append((shard, first, by_shard[shard]))
        first += by_shard[shard]
    plan = F.broadcast(spark.createDataFrame(plan, "shard int, first long, own long"))
    dealt = keyed.join(plan, "shard").withColumn("bucket", F.col("first") + F.pmod("hash", F.col("own"))).withColumn("task", F.floor(F.col("bucket") * tasks / max(buckets, 1)).cast("int"))

    counts = dealt.groupBy("shard", "bucket", "task").agg(F.count(F.lit(1)).alias("n"))
    before = "cast(coalesce(sum(n) over (partition by shard order by bucket rows between unbounded preceding and 1 preceding), 0) as long)"
    starts = counts.selectExpr("task", "shard", "bucket", f"{before} as start").repartitionById(tasks, F.col("task"))

    grown = F.when(F.xxhash64(F.lit(seed), F.col("id"), F.lit(shards)) > F.col("top.h"), F.lit(shards)).otherwise(F.col("shard"))
    one = F.struct(F.struct("id", "hash").alias("k"), "row", grown.alias("grown"))
    gathered = dealt.select("task", "shard", "bucket", one.alias("one")).repartitionById(tasks, F.col("task"))
    gathered = gathered.groupBy("task", "shard", "bucket").agg(F.collect_list("one").alias("rows"))
    in_order = F.array_sort("rows", lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
    # Sorted, so that the shuffles of a task, which draw from one generator, come in the same order each time.
    placed = gathered.join(starts.hint("shuffle_hash"), ["task", "shard", "bucket"]).sortWithinPartitions("bucket")
    mixed = placed.select("shard", "start", F.shuffle(in_order, F.lit(seed + 2)).alias("rows"))
    out = mixed.select("shard", "start", F.posexplode("rows").alias("at", "one"))
    row = [F.col("one.row").getField(c).alias(c) for c in plain]
    return out.select(*row, F.col("shard"), (F.col("start") + F.col("at")).alias("slot"), F.col("one.grown").alias("grown_shard"))


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType)) or (isinstance(kind, T.ArrayType) and _holds_map(kind.elementType))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write a folder for each shard; each file holds whole buckets in order of slot."""
    sharded.write.partitionBy("shard").parquet(path)


def shard_report(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The digest of ``shuffle_shards`` that the query returns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return shuffle_shards(docs.select("doc_id", "text"), shards).select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )
