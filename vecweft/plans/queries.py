"""Registered queries over the ``embeddings`` table. Searches ask for every vector whose id is divisible by 50."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import graphs, index, knn, merge, metrics, order, partition, tables
from ..storage import written
from .oracle import M, PARTS

K, EPSILON, MAX_NUM, NUM_DOCS, EVERY = 10, 1.4, 5, 3, 50
#: Queries of a block of byte vectors.
QUERY_ROWS = 4096
SETTINGS = index.Settings("l2", m=8, ef_construction=64)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def asked(base: DataFrame) -> DataFrame:
    return base.where(F.col("vec_id") % EVERY == 0)


def rounded(found: DataFrame, column: str = "dist") -> DataFrame:
    return found.withColumn(column, F.round(column, 6))


def exact(space: str, condition: str | None = None) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = vectors(spark, sf_dir)
        return rounded(knn.knn(asked(base), base.where(condition) if condition else base, K, space, exclude_self=True))

    return run


def stretched(base: DataFrame) -> DataFrame:
    """Vectors that are not of unit length, so that spaces order them differently."""
    return base.withColumn("embedding", F.transform("embedding", lambda x: (x * (1 + F.col("vec_id") % 5)).cast("float")))


def knn_stretched(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = stretched(vectors(spark, sf_dir))
    parts = [rounded(knn.knn(asked(base), base, K, space, exclude_self=True)).withColumn("space", F.lit(space)) for space in V.SPACES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(spark, sf_dir)
    allowed = base.where("vec_id % 3 = 0").select("vec_id")
    return rounded(knn.knn(asked(base), tables.keep_only(base, allowed), K, exclude_self=True))


def without_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(spark, sf_dir)
    return rounded(knn.knn(asked(base), tables.delete(base, base.where("vec_id % 10 = 3").select("vec_id")), K, exclude_self=True))


def radius_search(spark: SparkSession, sf_dir: str, max_num: int | None = None) -> DataFrame:
    base = vectors(spark, sf_dir)
    return rounded(knn.radius(asked(base), base, EPSILON, "l2", max_num))


def documents_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(spark, sf_dir).withColumnRenamed("label", "doc_id")
    return rounded(knn.document_search(asked(base), base, NUM_DOCS))


def distinct_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_found(spark, sf_dir).groupBy("q_id").agg(F.countDistinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("n"))


def self_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(spark, sf_dir)
    return metrics.self_recall(knn.knn(asked(base), base, 1))


def filtered_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of a search of the even ids only, against the search of all."""
    base = vectors(spark, sf_dir)
    found, truth = knn.knn(asked(base), base.where("vec_id % 2 = 0"), K), knn.knn(asked(base), base, K)
    return metrics.recall_by_query(found, truth, K)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(spark, sf_dir)
    return tables.get_items(base, asked(base)).select("vec_id", "label", F.size("embedding").alias("dim"))


def changed(base: DataFrame) -> DataFrame:
    new = base.where("vec_id % 7 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x)).withColumn("version", F.lit(2))
    return tables.upsert(base.withColumn("version", F.lit(1)), new)


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed(vectors(spark, sf_dir)).select("vec_id", "version", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def soft_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(spark, sf_dir).withColumn("deleted", F.lit(False))
    marked = tables.mark_deleted(base, base.where("vec_id % 10 = 3"))
    back = tables.unmark_deleted(marked, base.where("vec_id % 20 = 3"))
    return back.groupBy("deleted").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids"))


def slots_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(spark, sf_dir).withColumn("deleted", F.col("vec_id") % 10 == 3)
    new = base.where("vec_id % 25 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000_000).drop("deleted")
    return tables.replace_deleted(base, new).select("vec_id", "label", "deleted")


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = stretched(vectors(spark, sf_dir))
    return base.select("vec_id", F.posexplode(V.normalise(F.col("embedding"))).alias("at", "x")).withColumn("x", F.round("x", 6))


def byte_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(spark, sf_dir).select("vec_id", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int")).alias("b"))
    # A stated query set against all rows: each row is dealt to the blocks of queries, and meets those of its block.
    queries = asked(base).select(F.col("vec_id").alias("q_id"), F.col("b").alias("q"))
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("q_id"), F.lit(blocks)))
    gathered = queries.groupBy("block").agg(F.collect_list(F.struct("q_id", "q")).alias("queries"))
    rows = base.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    pairs = rows.join(F.broadcast(gathered) if blocks == 1 else gathered, "block").select("vec_id", "b", F.explode("queries").alias("one"))
    return pairs.select("one.q_id", "vec_id", V.l2_bytes(F.col("one.q"), F.col("b")).alias("dist"))


def _centroids(base: DataFrame, m: int = M) -> list[list[float]]:
    return partition.first_centroids(base, m)


def centroid_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, c) for i, c in enumerate(_centroids(vectors(spark, sf_dir)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return rounded(knn.knn(table, table, len(rows)).select(F.col("q_id").cast("int").alias("i"), F.col("vec_id").cast("int").alias("j"), "dist"))


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(spark, sf_dir)
    return rounded(partition.nearest_centroids(base, _centroids(base)).select("vec_id", "cid", "dist"))


def centroids_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(spark, sf_dir)
    new = partition.update_centroids(base, _centroids(base))
    return spark.createDataFrame(list(enumerate(new)), "cid int, c array<double>").select("cid", F.posexplode("c").alias("at", "x")).withColumn("x", F.round("x", 6))


def kmeans_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(spark, sf_dir)
    return partition.partition_sizes(partition.nearest_centroids(base, partition.kmeans(base, M)), M)


def overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(spark, sf_dir)
    return partition.overlap_assign(base, _centroids(base)).select("global_id", "cid", "rank", "local_id")


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.partition_sizes(overlapping(spark, sf_dir), M + 1)


def parts(spark: SparkSession, sf_dir: str, m: int = PARTS) -> DataFrame:
    return partition.random_partition(vectors(spark, sf_dir), m)


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("vec_id", "part_id", "local_id", "global_id")


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.offsets(parts(spark, sf_dir))


def cost(spark: SparkSession, sf_dir: str, m: int) -> list[list[float]]:
    table = spark.createDataFrame(list(enumerate(_centroids(vectors(spark, sf_dir), m))), "vec_id long, embedding array<double>")
    out = [[0.0] * m for _ in range(m)]
    for r in knn.knn(table, table, m).collect():
        out[r["q_id"]][r["vec_id"]] = r["dist"]
    return [[(out[i][j] + out[j][i]) / 2 for j in range(m)] for i in range(m)]


def _within(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """(part_id, src, rank, dst, dist): exact nearest neighbours of each vector in its partition."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        ids, rows = table["vec_id"].to_numpy(), index.arrays(table["embedding"])
        near, dist = graphs.nearest(rows, ids, k, "l2")
        n, k_ = near.shape
        part = table["part_id"][0].as_py()
        return pa.table({"part_id": pa.array([part] * (n * k_), pa.int32()), "src": ids.repeat(k_), "rank": pa.array(list(range(1, k_ + 1)) * n, pa.int32()), "dst": ids[near.ravel()], "dist": dist.ravel()})

    return parts(spark, sf_dir).select("part_id", "vec_id", "embedding").groupBy("part_id").applyInArrow(run, "part_id int, src long, rank int, dst long, dist double")


def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_within(spark, sf_dir, K))


def reverse_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many neighbours each vector is the neighbour of, and the least and largest of them."""
    return _within(spark, sf_dir, K).groupBy(F.col("dst").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("low"), F.max("src").alias("high"))


def degree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.degrees(_within(spark, sf_dir, K), vectors(spark, sf_dir))


def graph_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.integrity(_within(spark, sf_dir, K), vectors(spark, sf_dir))


def built(spark: SparkSession, sf_dir: str, m: int = PARTS) -> DataFrame:
    return index.build(parts(spark, sf_dir, m), SETTINGS)


def ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.search(built(spark, sf_dir), asked(vectors(spark, sf_dir)), K, ef=64)


def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(spark, sf_dir)
    return metrics.recall(ann_search(spark, sf_dir), knn.knn(asked(base), base, K), K)


def ann_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.search(built(spark, sf_dir), asked(vectors(spark, sf_dir)), K, ef=128, allowed=F.col("vec_id") % 3 == 0)


def diversified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.edges(built(spark, sf_dir))


def greedy_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.blocks(built(spark, sf_dir))


def merged(method: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = merge.merge(written(built(spark, sf_dir), "index"), order.merge_order(spark, "unweighted-graph", PARTS), method, SETTINGS.m)
        return index.edges(graph).select("src", "dst")

    return run


def merged_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(spark, sf_dir)
    graph = merge.merge(written(built(spark, sf_dir), "index"), order.merge_order(spark, "unweighted-graph", PARTS), "sliding", SETTINGS.m)
    return metrics.recall(index.search_linked(graph, asked(base), K, ef=100), knn.knn(asked(base), base, K), K)


def overlap_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact neighbours within overlapping clusters, joined."""
    base = vectors(spark, sf_dir)
    members = partition.nearest_centroids(base, _centroids(base), 2).select("vec_id", "cid").join(base, "vec_id")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        ids = table["vec_id"].to_numpy()
        near, _ = graphs.nearest(index.arrays(table["embedding"]), ids, K, "l2")
        return pa.table({"src": ids.repeat(near.shape[1]), "dst": ids[near.ravel()]})

    return merge.overlap_merge(members.select("cid", "vec_id", "embedding").groupBy("cid").applyInArrow(run, "src long, dst long"), m=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "knn_l2_exact": exact("l2"),
        "knn_ip_exact": exact("ip"),
        "knn_cosine_exact": exact("cosine"),
        "knn_spaces": knn_stretched,
        "knn_filtered": exact("l2", "label = 3"),
        "knn_divisible": exact("l2", "vec_id % 2 = 0"),
        "knn_allowlist_semi": allow_list,
        "knn_excl_deleted_anti": without_deleted,
        "range_search": radius_search,
        "range_search_capped": lambda s, d: radius_search(s, d, MAX_NUM),
        "multivector_search": documents_found,
        "multivector_docs": distinct_documents,
        "self_recall": self_recall,
        "recall_at_k": filtered_recall,
        "get_items": items,
        "upsert_latest": upserted,
        "soft_delete": soft_deleted,
        "replace_deleted": slots_replaced,
        "normalize": normalised,
        "l2_bytes": byte_distances,
        "pairwise_centroid_dist": centroid_distances,
        "assign_nearest_centroid": assigned,
        "centroid_update": centroids_updated,
        "kmeans_sizes": kmeans_sizes,
        "overlap_assign": overlapping,
        "partition_sizes": sizes,
        "random_partition": split,
        "partition_offsets": offsets,
        "order_pairwise": lambda s, d: order.pairwise(s, PARTS),
        "order_path": lambda s, d: order.merge_order(s, "path", PARTS),
        "order_circle": lambda s, d: order.merge_order(s, "circle", 8),
        "order_circulant": lambda s, d: order.merge_order(s, "unweighted-graph", 30),
        "order_petersen": lambda s, d: order.merge_order(s, "petersen", 10),
        "order_mst": lambda s, d: order.merge_order(s, "mst", 24, cost(s, d, 24)),
        "order_2hop": lambda s, d: order.merge_order(s, "weighted-graph", 30, cost(s, d, 30)),
        "knn_graph": knn_graph,
        "reverse_knn": reverse_knn,
        "degree_stats": degree_stats,
        "graph_integrity": graph_integrity,
        "overlap_merge": overlap_merged,
        "ann_search": ann_search,
        "ann_recall": ann_recall,
        "ann_filtered": ann_filtered,
        "diversified_edges": diversified,
        "greedy_blocks": greedy_blocks,
        "cross_merge": merged("cross"),
        "sliding_merge": merged("sliding"),
        "merged_recall": merged_recall,
    }
