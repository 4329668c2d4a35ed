import numpy as np
import pytest

from vecweft import cli
from vecweft.operators import index, knn, metrics
from vecweft.sources import idfiles, vecfiles

SCHEMA = "vec_id long, embedding array<float>"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder, rows = tmp_path_factory.mktemp("cli"), np.random.default_rng(8).random((400, 8)).astype(np.float32)
    base = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], SCHEMA).cache()
    vecfiles.write_vectors(base, f"{folder}/base.fvecs")
    vecfiles.write_vectors(base.where("vec_id < 30"), f"{folder}/query.fvecs")
    return folder, base


def run(spark, program, **options):
    argv = [program]
    for k, v in options.items():
        argv += [f"--{k}", *map(str, v)] if isinstance(v, list) else [f"--{k}"] if v is True else [f"--{k}", str(v)]
    cli.main(argv, spark)


def test_partitions_and_orders(spark, files):
    folder, base = files
    run(spark, "partition-random", num_clusters=3, db=f"{folder}/base.fvecs", out=f"{folder}/part")
    sizes = [vecfiles.read_vectors(spark, f"{folder}/part{i}.fvecs").count() for i in range(3)]
    assert sizes == [134, 133, 133]
    whole = [tuple(r["embedding"]) for r in vecfiles.read_vectors(spark, f"{folder}/part.fvecs").orderBy("vec_id").collect()]
    parts = [tuple(r["embedding"]) for i in range(3) for r in vecfiles.read_vectors(spark, f"{folder}/part{i}.fvecs").orderBy("vec_id").collect()]
    assert whole == parts and sorted(whole) == sorted(tuple(r["embedding"]) for r in base.collect())
    run(spark, "partition-kmeans", iterations=2, num_clusters=3, db=f"{folder}/base.fvecs", out=f"{folder}/km")
    assert vecfiles.read_vectors(spark, f"{folder}/km.fvecs").count() == 400
    run(spark, "partition-overlap", iterations=2, num_clusters=4, db=f"{folder}/base.fvecs", out=f"{folder}/over")
    placed = idfiles.read_idmaps(spark, f"{folder}/over.idmaps")
    assert placed.count() == 800 and placed.exceptAll(idfiles.read_locals(spark, f"{folder}/over.locals")).count() == 0
    for program in ("order-mst", "order-2hop"):
        run(spark, program, iterations=2, num_clusters=5, db=f"{folder}/base.fvecs", out=f"{folder}/{program}.fvecs")
    matrix = cli.order.read_matrix(spark, f"{folder}/order-mst.fvecs")
    assert len(matrix) == 5 and sum(x > 0 for row in matrix for x in row) == 4
    with pytest.raises(ValueError):
        cli.order.read_matrix(spark, f"{folder}/base.fvecs")


def test_build_merge_and_search(spark, files):
    folder, base = files
    data, query, gt = f"{folder}/base.fvecs", f"{folder}/query.fvecs", f"{folder}/gt.ivecs"
    run(spark, "ground-truth", base_file=data, query_file=query, gt_file=gt, dist_file=f"{folder}/gt.fvecs", k=20)
    truth = knn.knn(base.where("vec_id < 30"), base, 20)
    assert vecfiles.read_truth(spark, gt).select("q_id", "rank", "vec_id").exceptAll(truth.select("q_id", "rank", "vec_id")).count() == 0
    assert vecfiles.read_truth(spark, gt, f"{folder}/gt.fvecs").where("dist is null").count() == 0
    run(spark, "build", data=data, out=f"{folder}/parts", M=8, ef_construction=60, parts=3)
    run(spark, "build-one", data=data, out=f"{folder}/one", M=8, ef_construction=60)
    assert index.edges(spark.read.parquet(f"{folder}/one"), None).where("level > 0").count() == 0
    run(spark, "graph-export", index=f"{folder}/one", file=f"{folder}/one.bin", M=8, ef_construction=60)
    run(spark, "graph-import", file=f"{folder}/one.bin", out=f"{folder}/back")
    assert spark.read.parquet(f"{folder}/back").drop("links").exceptAll(spark.read.parquet(f"{folder}/one").drop("links")).count() == 0
    run(spark, "merge-cross", index=[f"{folder}/parts"], out=f"{folder}/cross", M=8, order="pairwise")
    run(spark, "merge-sliding", index=[f"{folder}/parts"], out=f"{folder}/sliding", M=8, order="mst", order_file=matrix_file(spark, folder))
    run(spark, "merge-overlap", index=[f"{folder}/parts"], out=f"{folder}/joined", M=8)
    for name in ("cross", "sliding"):
        run(spark, "search", index=f"{folder}/{name}", query=query, gt=gt, csv=f"{folder}/{name}.csv", k=10, min_ef=20, max_ef=60, step=40, linked=True)
        curve = idfiles.read_performance(spark, f"{folder}/{name}.csv").collect()
        assert {r["L"] for r in curve} == {20, 60} and max(r["recall"] for r in curve) > 0.9
    assert metrics.integrity(index.edges(spark.read.parquet(f"{folder}/joined")), base).where("rule = 'unknown_node'").first()["violations"] == 0


def matrix_file(spark, folder):
    path = f"{folder}/three.fvecs"
    cli.order.write_matrix(spark, [(0, 1), (1, 2)], 3, path)
    return path
