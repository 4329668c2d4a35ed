"""Partitioning of vectors: seeded shuffle and equal split, k-means, overlapping assignment, offsets and id maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import distances, matrix, one_by_one, unit

SEED = 42
#: Hexadecimal digits of the shuffle key that make a bucket: positions are counted within buckets, then offset.
BUCKET_DIGITS = 3
#: Bytes of centroids that are sent to the workers.
CENTROID_BYTES = 64 << 20


def shuffle_key(id_col: Column, seed: int = SEED) -> Column:
    """Orders rows at random but reproducibly."""
    return F.md5(F.concat(id_col.cast("string"), F.lit(f"-{seed}")))


def numbered(df: DataFrame, bucket: Column, *order: Column | str, within: tuple[str, ...] = (), name: str = "position") -> DataFrame:
    """``df`` with the row's place from 0 in the order of (bucket, order), for each value of the columns ``within``.

    Buckets are sorted apart, and a table of their sizes, small beside the rows, gives where each begins; no
    task sorts all rows.
    """
    rows = df.withColumn("__bucket", bucket)
    sizes = rows.groupBy(*within, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*(within or (F.lit(0),))).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("__start", before).drop("__n")
    at = F.row_number().over(Window.partitionBy(*within, "__bucket").orderBy(*order)) - 1
    return rows.withColumn("__at", at).join(starts, [*within, "__bucket"]).withColumn(name, (F.col("__start") + F.col("__at")).cast("long")).drop("__bucket", "__at", "__start")


def check_parts(m: int, least: int = 2) -> int:
    if m < least:
        raise ValueError(f"at least {least} partitions are needed, not {m}")
    return m


def random_partition(vectors: DataFrame, m: int, seed: int = SEED, id_col: str = "vec_id") -> DataFrame:
    """``vectors`` plus part_id, local_id (place in the part) and global_id (place in the shuffled whole).

    The shuffled rows are split into ``m`` runs whose sizes differ by one at most, the longer runs first.
    """
    check_parts(m)
    key = shuffle_key(F.col(id_col), seed)
    rows = numbered(vectors.withColumn("__key", key), F.substring("__key", 1, BUCKET_DIGITS), "__key", id_col, name="global_id").drop("__key")
    n = vectors.count()
    size, longer = divmod(n, m)
    at, edge = F.col("global_id"), longer * (size + 1)
    part = F.when(at < edge, F.floor(at / (size + 1))).otherwise(longer + F.floor((at - edge) / max(size, 1))).cast("int")
    local = F.when(at < edge, at % (size + 1)).otherwise((at - edge) % max(size, 1))
    return rows.withColumn("part_id", part).withColumn("local_id", local.cast("long"))


def first_centroids(vectors: DataFrame, m: int, seed: int = SEED, id_col: str = "vec_id", vector: str = "embedding") -> list[list[float]]:
    """The first m vectors in shuffled order."""
    rows = vectors.select(shuffle_key(F.col(id_col), seed).alias("k"), id_col, vector).orderBy("k", id_col).limit(m).collect()
    return [r[2] for r in rows]


def _centroids(centroids: list[list[float]], space: str) -> np.ndarray:
    table = np.array(centroids, np.float64)
    if table.nbytes > CENTROID_BYTES:
        raise ValueError(f"{len(table)} centroids exceed {CENTROID_BYTES} bytes; partition in two levels")
    return unit(table) if space == "cosine" else table


def nearest_centroids(vectors: DataFrame, centroids: list[list[float]], kbase: int = 1, space: str = "l2", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, rank, cid, dist): the ``kbase`` closest centroids of each vector, ties by centroid number."""
    table = _centroids(centroids, space)
    kbase = min(kbase, len(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(1))
            rows = unit(rows) if space == "cosine" else rows
            if not len(rows):
                continue
            near = np.argsort(distances(rows, table, space), axis=1, kind="stable")[:, : kbase + 2]
            exact = one_by_one(rows[:, None, :], table[near], space)
            order = np.lexsort((near, exact), axis=1)[:, :kbase]
            near, exact = np.take_along_axis(near, order, 1), np.take_along_axis(exact, order, 1)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, kbase)), pa.array(np.tile(np.arange(1, kbase + 1, dtype=np.int32), len(ids))), pa.array(near.ravel().astype(np.int32)), pa.array(exact.ravel())], ["vec_id", "rank", "cid", "dist"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v")).where("vec_id is not null and v is not null").mapInArrow(run, "vec_id long, rank int, cid int, dist double")


def centroid_sums(vectors: DataFrame, centroids: list[list[float]], space: str = "l2", vector: str = "embedding") -> DataFrame:
    """(cid, n, total): each task adds its vectors by closest centroid, so few rows are shuffled."""
    table = _centroids(centroids, space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, sizes = np.zeros_like(table), np.zeros(len(table), np.int64)
        for batch in batches:
            rows = matrix(batch.column(0))
            if not len(rows):
                continue
            own = distances(unit(rows) if space == "cosine" else rows, table, space).argmin(1)
            np.add.at(totals, own, rows)
            sizes += np.bincount(own, minlength=len(table))
        some = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sizes[some]), pa.array(list(totals[some]), pa.list_(pa.float64()))], ["cid", "n", "total"])

    return vectors.select(F.col(vector).alias("v")).where("v is not null").mapInArrow(run, "cid int, n long, total array<double>")


def update_centroids(vectors: DataFrame, centroids: list[list[float]], space: str = "l2", vector: str = "embedding") -> list[list[float]]:
    """One round: the mean of the vectors closest to each centroid; a centroid without vectors stays."""
    new = [list(c) for c in centroids]
    totals = centroid_sums(vectors, centroids, space, vector).select("cid", "n", F.posexplode("total").alias("at", "x"))
    means = totals.groupBy("cid", "at").agg((F.sum("x") / F.sum("n")).alias("x"))
    for row in means.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("c")).collect():
        new[row["cid"]] = [p["x"] for p in row["c"]]
    return new


def kmeans(vectors: DataFrame, m: int, iterations: int = 20, seed: int = SEED, sample: int = 256_000, space: str = "l2", id_col: str = "vec_id", vector: str = "embedding") -> list[list[float]]:
    """Centroids by Lloyd's rounds, from the first m vectors in shuffled order. Rounds run on the first ``sample``
    vectors of that order (by a share of the key's range, so about as many); pass None to use all."""
    check_parts(m)
    centroids = first_centroids(vectors, m, seed, id_col, vector)
    if sample is not None and (n := vectors.count()) > sample:
        limit = f"{int(16**8 * sample / n):08x}"
        vectors = vectors.where(F.substring(shuffle_key(F.col(id_col), seed), 1, 8) < limit)
    for _ in range(iterations):
        new = update_centroids(vectors, centroids, space, vector)
        if new == centroids:
            break
        centroids = new
    return centroids


def overlap_assign(vectors: DataFrame, centroids: list[list[float]], kbase: int = 2, space: str = "l2", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(global_id, cid, rank, local_id): each vector goes to its ``kbase`` closest clusters; local ids follow global ids."""
    check_parts(len(centroids), 3)
    found = nearest_centroids(vectors, centroids, kbase, space, id_col, vector).select(F.col("vec_id").alias("global_id"), "cid", "rank")
    return id_map(found)


def id_map(assignments: DataFrame) -> DataFrame:
    """``assignments`` (global_id, cid, ...) plus local_id: the place of the global id in its cluster."""
    ids = assignments.agg(F.max("global_id")).first()[0] or 0
    width = max(1, (ids + 1) // (16**BUCKET_DIGITS) + 1)
    return numbered(assignments, F.floor(F.col("global_id") / width), "global_id", within=("cid",), name="local_id")


def partition_sizes(parts: DataFrame, m: int, part: str = "cid") -> DataFrame:
    """(part, n) of all m partitions, empty ones included."""
    every = parts.sparkSession.range(m).select(F.col("id").cast("int").alias(part))
    return every.join(parts.groupBy(part).agg(F.count(F.lit(1)).alias("n")), part, "left").na.fill(0, ["n"])


def offsets(parts: DataFrame, part: str = "part_id") -> DataFrame:
    """(part, n, offset): where each partition begins in the concatenation."""
    sizes = parts.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    return sizes.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long"))
