"""Command line: ``python -m vecweft.cli PROGRAM ...``; each program's options are listed by ``--help``.

Vector files are of any kind that ``vecweft.sources.vecfiles`` reads; index tables are Parquet folders.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import index, knn, merge, metrics, order, partition
from .sources import graphfiles, idfiles, vecfiles
from .storage import written


def _vectors(spark: SparkSession, path: str) -> DataFrame:
    return vecfiles.read_vectors(spark, path)


def _index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(index.INDEX).parquet(path)


def _settings(args: argparse.Namespace) -> index.Settings:
    return index.Settings(args.space, args.M, args.ef_construction)


def _centroids(spark: SparkSession, args: argparse.Namespace) -> list[list[float]]:
    return partition.kmeans(_vectors(spark, args.db), args.num_clusters, args.iterations)


def partition_random(spark: SparkSession, args: argparse.Namespace) -> None:
    placed = written(partition.random_partition(_vectors(spark, args.db), args.num_clusters), "placed")
    vecfiles.write_partitions(placed.select("part_id", F.col("global_id").alias("vec_id"), "embedding"), args.out, args.suffix)


def partition_kmeans(spark: SparkSession, args: argparse.Namespace) -> None:
    base = _vectors(spark, args.db)
    near = partition.nearest_centroids(base, _centroids(spark, args)).select("vec_id", F.col("cid").alias("part_id"))
    vecfiles.write_partitions(written(base.join(near, "vec_id"), "placed"), args.out, args.suffix)


def partition_overlap(spark: SparkSession, args: argparse.Namespace) -> None:
    base = _vectors(spark, args.db)
    placed = written(partition.overlap_assign(base, _centroids(spark, args), args.kbase), "placed")
    idfiles.write_assignments(placed, f"{args.out}.assignments")
    idfiles.write_idmaps(placed, args.num_clusters, f"{args.out}.idmaps")
    idfiles.write_locals(placed, f"{args.out}.locals")
    rows = placed.select(F.col("global_id").alias("vec_id"), F.col("cid").alias("part_id")).join(base, "vec_id")
    vecfiles.write_partitions(rows, args.out, args.suffix)


def _cost(spark: SparkSession, args: argparse.Namespace) -> list[list[float]]:
    centres = _centroids(spark, args)
    return [[sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) for b in centres] for a in centres]


def order_2hop(spark: SparkSession, args: argparse.Namespace) -> None:
    cost = _cost(spark, args)
    pairs = order.two_hop(cost, args.R)
    print(f"average degree {order.average_degree(pairs, len(cost)):.3f}")
    order.write_matrix(spark, pairs, len(cost), args.out, cost)


def order_mst(spark: SparkSession, args: argparse.Namespace) -> None:
    cost = _cost(spark, args)
    order.write_matrix(spark, order.minimum_spanning_tree(cost), len(cost), args.out, cost)


def build(spark: SparkSession, args: argparse.Namespace) -> None:
    """A sub-index, or with --parts an index of so many random partitions."""
    base = _vectors(spark, args.data)
    placed = partition.random_partition(base, args.parts) if args.parts > 1 else base.withColumn("part_id", F.lit(args.part_id))
    placed = placed.withColumn("vec_id", F.col("vec_id") + args.first_id)
    index.build(placed, _settings(args)).write.mode("overwrite").parquet(args.out)


def build_one(spark: SparkSession, args: argparse.Namespace) -> None:
    """All vectors in one graph of level 0 alone: the baseline."""
    settings = index.Settings(args.space, args.M, args.ef_construction, hierarchical=False)
    index.build(_vectors(spark, args.data).withColumn("part_id", F.lit(0)), settings).write.mode("overwrite").parquet(args.out)


def graph_import(spark: SparkSession, args: argparse.Namespace) -> None:
    """An index file becomes an index table."""
    graphfiles.read_graph(spark, args.file, args.part_id).write.mode("overwrite").parquet(args.out)


def graph_export(spark: SparkSession, args: argparse.Namespace) -> None:
    """An index table of one partition becomes an index file."""
    graphfiles.write_graph(_index(spark, args.index), args.file, _settings(args))


def _order(spark: SparkSession, args: argparse.Namespace, m: int) -> DataFrame:
    return order.merge_order(spark, args.order, m, weights=order.read_matrix(spark, args.order_file) if args.order_file else None)


def _merged(spark: SparkSession, args: argparse.Namespace, method: str, **beam) -> None:
    table = None
    for path in args.index:
        table = _index(spark, path) if table is None else table.unionByName(_index(spark, path))
    m = table.agg(F.max("part_id")).first()[0] + 1
    merge.merge(table, _order(spark, args, m), method, args.M, args.space, **beam).write.mode("overwrite").parquet(args.out)


def merge_cross(spark: SparkSession, args: argparse.Namespace) -> None:
    _merged(spark, args, "cross", ef=args.ef, stop_ratio=args.stop_ratio)


def merge_sliding(spark: SparkSession, args: argparse.Namespace) -> None:
    _merged(spark, args, "sliding", global_ef=args.global_ef, local_ef=args.local_ef, self_ef=args.self_ef)


def merge_overlap(spark: SparkSession, args: argparse.Namespace) -> None:
    """Indexes of overlapping partitions, by global id, become one: each vector keeps links of all its sub-graphs."""
    table = None
    for path in args.index:
        table = _index(spark, path) if table is None else table.unionByName(_index(spark, path))
    links = merge.overlap_merge(index.edges(table), args.M).groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("to"))
    rows = table.dropDuplicates(["vec_id"]).join(links, F.col("vec_id") == F.col("src"), "left")
    flat = rows.select(F.lit(0).alias("part_id"), "vec_id", F.lit(0).alias("level"), "deleted", "embedding", F.array(F.coalesce("to", F.expr("cast(array() as array<bigint>)"))).alias("links"))
    flat.write.mode("overwrite").parquet(args.out)


def search(spark: SparkSession, args: argparse.Namespace) -> None:
    """Recall and queries a second for each beam width, as a CSV with the columns L, recall and QPS."""
    table, queries = _index(spark, args.index).persist(), _vectors(spark, args.query).persist()
    table.count()
    truth = written(vecfiles.read_truth(spark, args.gt).where(F.col("rank") <= args.k), "truth")
    find = index.search_linked if args.linked else index.search
    rows = metrics.sweep(lambda ef: find(table, queries, args.k, ef, args.space), truth, args.k, range(args.min_ef, args.max_ef + 1, args.step))
    found = spark.createDataFrame(rows, "L int, recall double, QPS double")
    idfiles.write_performance(found, args.csv)
    metrics.by_recall(found).show(len(rows), False)
    table.unpersist()
    queries.unpersist()


def ground_truth(spark: SparkSession, args: argparse.Namespace) -> None:
    found = knn.knn(_vectors(spark, args.query_file), _vectors(spark, args.base_file), args.k, args.space, strict=True)
    vecfiles.write_truth(written(found, "truth"), args.gt_file, args.dist_file)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vecweft", description=__doc__)
    programs = top.add_subparsers(dest="program", required=True)

    def program(name: str, run: Callable, *options: tuple) -> None:
        sub = programs.add_parser(name, help=run.__doc__)
        sub.set_defaults(run=run)
        for option, settings in options:
            sub.add_argument(option, **settings)

    text = dict(required=True)
    number = lambda default=None: dict(type=int, default=default, required=default is None)
    space = ("--space", dict(default="l2", choices=("l2", "ip", "cosine")))
    graph = (("--M", number(16)), ("--ef_construction", number(200)), space)
    clusters = (("--num_clusters", number()), ("--db", text), ("--out", text))
    suffix, rounds = ("--suffix", dict(default=".fvecs")), ("--iterations", number(20))
    merging = (("--index", dict(required=True, nargs="+")), ("--out", text), ("--M", number(16)), space)
    ordered = (("--order", dict(default="unweighted-graph")), ("--order_file", dict(default=None)))
    program("partition-random", partition_random, *clusters, suffix)
    program("partition-kmeans", partition_kmeans, *clusters, suffix, rounds)
    program("partition-overlap", partition_overlap, *clusters, suffix, rounds, ("--kbase", number(2)))
    program("order-2hop", order_2hop, *clusters, rounds, ("--R", dict(type=int, default=None)))
    program("order-mst", order_mst, *clusters, rounds)
    program("build", build, ("--data", text), ("--out", text), *graph, ("--parts", number(1)), ("--part_id", number(0)), ("--first_id", number(0)))
    program("build-one", build_one, ("--data", text), ("--out", text), *graph)
    program("graph-import", graph_import, ("--file", text), ("--out", text), ("--part_id", number(0)))
    program("graph-export", graph_export, ("--index", text), ("--file", text), *graph)
    program("merge-cross", merge_cross, *merging, *ordered, ("--ef", number(40)), ("--stop_ratio", dict(type=float, default=None)))
    program("merge-sliding", merge_sliding, *merging, *ordered, ("--global_ef", number(40)), ("--local_ef", number(10)), ("--self_ef", number(3)))
    program("merge-overlap", merge_overlap, *merging)
    program("search", search, ("--index", text), ("--query", text), ("--gt", text), ("--csv", text), ("--k", number(10)), ("--min_ef", number(10)), ("--max_ef", number(150)), ("--step", number(10)), ("--linked", dict(action="store_true")), space)
    program("ground-truth", ground_truth, ("--base_file", text), ("--query_file", text), ("--gt_file", text), ("--dist_file", text), ("--k", number(100)), space)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(spark or SparkSession.builder.appName(f"vecweft {args.program}").getOrCreate(), args)


if __name__ == "__main__":
    main(sys.argv[1:])
