"""Registered queries over files, index calls, programs and streams: what goes through them comes back the same."""

from __future__ import annotations

import pickle
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..api import FlatIndex, Index, LazyIndex
from ..functions import vector as V
from ..operators import index, knn, merge, metrics, order, partition
from ..sources import idfiles, vecfiles
from ..storage import new_path, written
from ..streaming import upserts
from .queries import EPSILON, K, PARTS, SETTINGS, _centroids, asked, built, overlapping, parts, rounded, vectors

FLOATS, WHOLE = (".fvecs", ".fbin"), (".ivecs", ".ibin", ".bvecs", ".u8bin")
RECALL = 0.95


def _totals(rows: DataFrame, name: str) -> DataFrame:
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select(F.lit(name).alias("format"), "vec_id", F.size("embedding").alias("dim"), F.round(total, 4).alias("total"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def as_bytes(base: DataFrame) -> DataFrame:
    return base.select("vec_id", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int")).alias("embedding"))


def vector_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors through files of each kind and back."""
    base, found = vectors(spark, sf_dir), []
    for suffix in (*FLOATS, *WHOLE):
        path = new_path(spark, f"base{suffix}")
        vecfiles.write_vectors(base if suffix in FLOATS else as_bytes(base), path)
        found.append(_totals(vecfiles.read_vectors(spark, path), suffix))
    return _union(found)


def vector_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 100 to 149 and, clamped, from 450 on of a file; and all of one without header."""
    base = vectors(spark, sf_dir)
    path, raw = new_path(spark, "base.fbin"), new_path(spark, "base.raw")
    vecfiles.write_vectors(base, path)
    vecfiles.write_vectors(base, raw, layout="raw", element="f4")
    return _union([
        _totals(vecfiles.read_vectors(spark, path, startIdx=100, chunkSize=50), "slice"),
        _totals(vecfiles.read_vectors(spark, path, startIdx=450, chunkSize=1 << 30), "clamped"),
        _totals(vecfiles.read_vectors(spark, raw, layout="raw", element="f4", dim=64), "raw"),
    ])


def truth_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth as files of ids and distances, as the program writes them; queries are rows of a file, so ids are places."""
    base = vectors(spark, sf_dir)
    paths = [new_path(spark, name) for name in ("base.fvecs", "query.fvecs", "truth.ivecs", "truth.fvecs")]
    vecfiles.write_vectors(base, paths[0])
    vecfiles.write_vectors(asked(base), paths[1])
    cli.main(["ground-truth", "--base_file", paths[0], "--query_file", paths[1], "--gt_file", paths[2], "--dist_file", paths[3], "--k", str(K)], spark)
    return vecfiles.read_truth(spark, paths[2], paths[3]).select("q_id", "rank", "vec_id", F.round("dist", 4).alias("dist"))


def partition_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random partitions by the program: rows of each file and of the concatenation."""
    base, out = new_path(spark, "base.fvecs"), new_path(spark, "part")
    vecfiles.write_vectors(vectors(spark, sf_dir), base)
    cli.main(["partition-random", "--num_clusters", str(PARTS), "--db", base, "--out", out], spark)
    files = [(str(i), f"{out}{i}.fvecs") for i in range(PARTS)] + [("all", f"{out}.fvecs")]
    return _union([_totals(vecfiles.read_vectors(spark, path), name) for name, path in files])


def id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping assignments through the three files of ids."""
    placed, found = written(overlapping(spark, sf_dir), "placed"), []
    for name, write, read in (
        ("assignments", idfiles.write_assignments, idfiles.read_assignments),
        ("idmaps", lambda df, path: idfiles.write_idmaps(df, 6, path), idfiles.read_idmaps),
        ("locals", idfiles.write_locals, idfiles.read_locals),
    ):
        path = new_path(spark, name)
        spark.range(1).write.parquet(path + ".folder")  # makes the parent
        write(placed, path)
        rows = read(spark, path)
        local = F.col("local_id") if "local_id" in rows.columns else F.lit(None)
        found.append(rows.select(F.lit(name).alias("file"), "global_id", "cid", local.cast("long").alias("local_id")))
    return _union(found)


def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = overlapping(spark, sf_dir)
    wanted = spark.range(20).select((F.col("id") % 7).cast("int").alias("cid"), F.col("id").alias("local_id"))
    return idfiles.local_to_global(wanted, placed).select("cid", "local_id", "global_id")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Performance tables and merge times through their files."""
    rows = vectors(spark, sf_dir).where("vec_id < 20").select(F.col("vec_id").cast("int").alias("L"), (F.col("vec_id") % 5 / 4.0).alias("recall"), (100.0 - F.col("vec_id")).alias("QPS"))
    path, log = new_path(spark, "curve.csv"), new_path(spark, "log")
    idfiles.write_performance(rows, path)
    rows.where("L < 1").select(F.lit("Start\nMerge time: 12.5 s\nEnd").alias("value")).coalesce(1).write.text(log)
    curve = idfiles.read_performance(spark, path).select(F.lit("curve").alias("file"), F.col("L").alias("key"), "recall", F.col("QPS").alias("value"))
    times = idfiles.read_merge_times(spark, log).select(F.lit("log").alias("file"), F.lit(0).alias("key"), F.lit(None).cast("double").alias("recall"), F.col("seconds").alias("value"))
    return curve.unionByName(times)


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("value is not null")
    return metrics.timing(events, "value").select(*(F.round(c, 6).alias(c) for c in ("mean", "median", "stddev")))


def flat_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact index through its calls: insert, delete, save, load, search under a Python predicate."""
    base = vectors(spark, sf_dir)
    flat = FlatIndex("l2", 64, spark)
    flat.init_index(1_000_000)
    flat.add_items(base.select("vec_id", "embedding"))
    flat.delete_vector(6)
    path = new_path(spark, "flat")
    flat.save_index(path)
    again = FlatIndex("l2", 64, spark)
    again.load_index(path)
    return rounded(again.knn_query(asked(base), K, filter=lambda i: i % 3 == 0))


def index_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index through its calls: (name, value) of what they answer."""
    base = vectors(spark, sf_dir).select("vec_id", "embedding")
    lazy = LazyIndex("l2", 64, spark=spark)
    rows: list[tuple[str, float]] = [("lazy_count", lazy.get_current_count()), ("lazy_items", len(lazy.get_items([]))), ("lazy_found", len(lazy.knn_query([[0.0] * 64])[0]))]
    one = Index("l2", 64, spark=spark)
    one.init_index(1_000_000, M=8, ef_construction=64, allow_replace_deleted=True)
    one.set_ef(64)
    one.add_items(base.where("vec_id < 300"))
    one.graph()
    one.add_items(base.where("vec_id >= 300 and vec_id < 400"))
    rows += [("count", one.get_current_count()), ("max_elements", one.get_max_elements()), ("M", one.M), ("ef", one.ef), ("ef_construction", one.ef_construction), ("ids", sum(one.get_ids_list()))]
    one.mark_deleted(6)
    one.mark_deleted(7)
    one.unmark_deleted(7)
    path = new_path(spark, "index")
    one.save_index(path)
    copy = Index("l2", 64, spark=spark)
    copy.load_index(path, allow_replace_deleted=True)
    queries = base.where("vec_id < 10")
    rows.append(("deleted_found", copy.knn_query(queries, K).where("vec_id = 6").count()))
    rows.append(("itself_first", copy.knn_query(queries, 1).where("q_id = vec_id").count()))
    rows.append(("as_before", copy.knn_query(queries, K).exceptAll(one.knn_query(queries, K)).count()))
    copy.add_items(base.where("vec_id = 450"), replace_deleted=True)
    rows += [("count_replaced", copy.get_current_count()), ("slot_gone", int(6 in copy.get_ids_list())), ("item", len(copy.get_items([450, 7])))]
    copy.resize_index(2_000_000)
    rows += [("resized", copy.get_max_elements()), ("pickled", pickle.loads(pickle.dumps(copy)).get_current_count()), ("copied", Index(index=copy, spark=spark).get_current_count()), ("saved_bytes", int(one.index_file_size(path) > 0))]
    return spark.createDataFrame([(n, float(v)) for n, v in rows], "name string, value double")


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as a stream of changes: all inserted, then every seventh negated and every tenth deleted."""
    base = vectors(spark, sf_dir)
    source, table, checkpoint = (new_path(spark, name) for name in ("in", "table", "checkpoint"))
    first = base.select("vec_id", "embedding", F.lit("upsert").alias("op"), F.lit(1).cast("long").alias("version"))
    changed = base.where("vec_id % 7 = 0").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"), F.lit("upsert").alias("op"), F.lit(2).cast("long").alias("version"))
    gone = base.where("vec_id % 10 = 3").select("vec_id", F.lit(None).cast("array<float>").alias("embedding"), F.lit("delete").alias("op"), F.lit(3).cast("long").alias("version"))
    for rows in (first, changed.unionByName(gone)):
        rows.coalesce(1).write.mode("append").parquet(source)
        upserts.start(spark.readStream.schema(upserts.CHANGES).parquet(source), table, checkpoint, available_now=True, compact_every=2).awaitTermination()
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6)
    return upserts.current(spark, table).select("vec_id", "version", "deleted", total.alias("total"))


def normalised_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(spark, sf_dir).select("vec_id", F.transform("embedding", lambda x: (x * (F.col("vec_id") % 5)).cast("float")).alias("embedding"))
    return base.select("vec_id", F.posexplode(V.normalise_rows(F.col("embedding"))).alias("at", "x")).withColumn("x", F.round("x", 5) + 0.0)


def largest_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.partition_sizes(overlapping(spark, sf_dir), 6).agg(F.max("n").alias("n"))


def degree_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [(r["i"], r["j"]) for r in order.circulant(spark, 30).collect()]
    return spark.createDataFrame([(order.average_degree(pairs, 30),)], "degree double")


def strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(spark, sf_dir)
    return rounded(knn.knn(asked(base), base, K, strict=True))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fact, holds): what must hold of approximate results, measured against exact ones."""
    base = vectors(spark, sf_dir)
    graph, queries = written(built(spark, sf_dir), "graph"), asked(base)
    truth = written(knn.knn(queries, base, K), "truth")
    share = lambda found, want=truth: metrics.recall(found, want, K).first()["recall"] or 0.0
    pairs = order.merge_order(spark, "unweighted-graph", PARTS)
    out: list[tuple[str, bool]] = [("search finds the nearest", share(index.search(graph, queries, K, 64)) >= RECALL)]
    odd = index.search(graph, queries, K, 128, allowed=F.col("vec_id") % 3 == 0)
    out.append(("filtered search returns only what is allowed", odd.where("vec_id % 3 <> 0").count() == 0))
    out.append(("filtered search finds the nearest allowed", share(odd, knn.knn(queries, base.where("vec_id % 3 = 0"), K)) >= RECALL))
    for method in ("cross", "sliding"):
        merged = written(merge.merge(graph, pairs, method, SETTINGS.m), "merged")
        out.append((f"{method} merge: recall across links", share(index.search_linked(merged, queries, K, 100)) >= RECALL))
        out.append((f"{method} merge: recall as one", share(index.search(merge.as_one(merged), queries, K, 100)) >= RECALL))
        links = index.edges(merged)
        out.append((f"{method} merge: no broken links", metrics.integrity(links, base).where("rule <> 'unreached_node' and violations > 0").count() == 0))
        out.append((f"{method} merge: degrees bounded", metrics.degrees(links, base).first()["max_out"] <= 2 * SETTINGS.m))
    blocks = index.blocks(graph)
    out.append(("blocks cover each vector once", blocks.count() == blocks.select("member").distinct().count() == base.count()))
    out.append(("more members than centres are not lost", merge.block_ratio(blocks).first()["members"] + blocks.select("bid").distinct().count() == base.count()))
    flat = merge.concat(graph)
    out.append(("concatenation links nothing across", index.edges(flat).join(parts(spark, sf_dir).select(F.col("vec_id").alias("src"), F.col("part_id").alias("p")), "src").join(parts(spark, sf_dir).select(F.col("vec_id").alias("dst"), F.col("part_id").alias("q")), "dst").where("p <> q").count() == 0))
    first, better = _centroids(base), partition.kmeans(base, 6)
    spread = lambda centres: partition.nearest_centroids(base, centres).agg(F.sum("dist")).first()[0]
    out.append(("k-means lowers the cost", spread(better) <= spread(first)))
    near = index.search_radius(graph, queries, EPSILON)
    exact = knn.radius(queries, base, EPSILON)
    both = near.select("q_id", "vec_id").intersect(exact.select("q_id", "vec_id")).count()
    out.append(("radius search over the graph", both == near.count() and both >= RECALL * exact.count()))
    cost = index.search_cost(graph, queries, K, 64).agg(F.min("hops"), F.max("distances")).first()
    out.append(("search explores its beam and computes few distances twice", cost[0] >= 64 and cost[1] <= 2 * base.count()))
    grown = index.add(written(index.build(parts(spark, sf_dir).where("vec_id % 4 <> 1"), SETTINGS), "three_quarters"), base.where("vec_id % 4 = 1"), SETTINGS)
    out.append(("search after insertion", share(index.search(grown, queries, K, 64)) >= RECALL))
    return spark.createDataFrame(out, "fact string, holds boolean")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "vector_files": vector_files,
        "vector_slices": vector_slices,
        "truth_files": truth_files,
        "partition_files": partition_files,
        "id_files": id_files,
        "local_to_global": looked_up,
        "measurement_files": measurements,
        "timing": timings,
        "flat_index_calls": flat_calls,
        "index_calls": index_calls,
        "stream_upserts": streamed,
        "normalize_rows": normalised_rows,
        "largest_partition": largest_part,
        "order_degree": degree_of_order,
        "knn_strict": strict,
        "approximate_facts": facts,
    }
