"""The index classes, files, streams and registered queries."""

import glob
import os
import pickle

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vecweft.api import FlatIndex, Index, LazyIndex, ObjectIndex
from vecweft.sources import idfiles, vecfiles
from vecweft.streaming import upserts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    return np.random.default_rng(5).random((300, 8)).astype(np.float32)


def test_index(spark, rows, tmp_path):
    index = Index("l2", 8, spark=spark)
    with pytest.raises(RuntimeError):
        index.get_current_count()
    index.init_index(400, M=8, ef_construction=60, allow_replace_deleted=True)
    with pytest.raises(RuntimeError):
        index.init_index(1)
    index.add_items(rows[:200])
    index.set_ef(50)
    assert (index.M, index.ef_construction, index.ef, index.max_elements, index.element_count) == (8, 60, 50, 400, 200)
    labels, dist = index.knn_query(rows[:20], 3)
    assert labels[:, 0].tolist() == list(range(20)) and np.abs(dist[:, 0]).max() < 1e-6
    assert index.knn_query(rows[0], 2, filter=lambda i: i % 2 == 1)[0].min() % 2 == 1
    index.mark_deleted(0)
    with pytest.raises(ValueError):
        index.mark_deleted(0)
    assert 0 not in index.knn_query(rows[:1], 5)[0] and 0 in index.get_ids_list()
    with pytest.raises(KeyError):
        index.get_items([0])
    with pytest.raises(RuntimeError):
        index.add_items(rows[:1], [0])
    index.add_items(rows[200:201], [900], replace_deleted=True)
    assert index.get_current_count() == 200 and 0 not in index.get_ids_list()
    assert np.allclose(index.get_items([900, 5]), rows[[200, 5]])
    with pytest.raises(ValueError):
        index.get_items(5)
    with pytest.raises(RuntimeError):
        index.knn_query(rows[0], 500)
    with pytest.raises(RuntimeError):
        index.resize_index(10)
    index.resize_index(500)
    path = str(tmp_path / "index")
    index.save_index(path)
    again = Index("l2", 8, spark=spark)
    again.load_index(path, 600)
    assert again.get_max_elements() == 600 and index.index_file_size(path) > 0
    copies = [again, pickle.loads(pickle.dumps(index)), Index(index=index)]
    want = index.knn_query(rows[:10], 4)[0].tolist()
    assert all(c.knn_query(rows[:10], 4)[0].tolist() == want for c in copies)
    with pytest.raises(ValueError):
        Index("ip", 8, spark=spark).load_index(path)
    with pytest.raises(ValueError):
        index.add_items(rows[:, :4])


def test_flat_lazy_and_objects(spark, rows):
    flat = FlatIndex("cosine", 8, spark=spark)
    flat.init_index(300)
    flat.add_items(rows)
    labels, dist = flat.knn_query(rows[:5] * 3, 1)
    assert labels.ravel().tolist() == list(range(5)) and np.abs(dist).max() < 1e-6
    flat.delete_vector(0)
    assert flat.get_current_count() == 299 and 0 not in flat.knn_query(rows[:1], 3)[0]
    with pytest.raises(RuntimeError):
        flat.add_items(rows[:3], [1000, 1001, 1002])
    lazy = LazyIndex("l2", 8, spark=spark)
    assert lazy.knn_query(rows[0]) == ([], [])
    named = ObjectIndex(lazy)
    named.add_items(rows[:10], [f"object {i}" for i in range(10)])
    assert named.knn_query(rows[3])[0] == [["object 3"]]


@pytest.mark.parametrize("suffix", list(vecfiles.SUFFIXES))
def test_vector_files_round_trip(spark, tmp_path, suffix, monkeypatch):
    monkeypatch.setattr(vecfiles, "READ", 64)
    path, values = str(tmp_path / f"x{suffix}"), [[i % 250, 1, 2] for i in range(50)]
    vecfiles.write_vectors(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(values)], "vec_id long, embedding array<float>"), path)
    layout, element = vecfiles.SUFFIXES[suffix]
    assert os.path.getsize(path) == 50 * 3 * np.dtype(element).itemsize + (200 if layout == "vecs" else 8)
    back = vecfiles.read_vectors(spark, path)
    assert [r["embedding"] for r in back.orderBy("vec_id").collect()] == values
    part = vecfiles.read_vectors(spark, path, startIdx=45, chunkSize=20).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in part] == list(range(45, 50))
    with open(path, "ab") as f:
        f.write(b"\1")
    if layout == "vecs":
        with pytest.raises(Exception, match="cut off"):
            vecfiles.read_vectors(spark, path).count()
        assert vecfiles.read_vectors(spark, path, mode="DROPMALFORMED").count() == 50


def test_odd_vector_files(spark, tmp_path):
    raw = tmp_path / "x.data"
    raw.write_bytes(np.arange(12, dtype="<f4").tobytes())
    got = vecfiles.read_vectors(spark, str(raw), layout="raw", element="f4", dim=4)
    assert got.count() == 3
    mixed = tmp_path / "m.ivecs"
    mixed.write_bytes(np.array([2, 7, 8, 1, 9], "<i4").tobytes())
    assert [r["embedding"] for r in vecfiles.read_vectors(spark, str(mixed), mode="DROPMALFORMED").orderBy("vec_id").collect()] == [[7, 8], [9]]
    with pytest.raises(ValueError):
        vecfiles.kind_of("x.txt", {})


def test_id_files_and_tables(spark, tmp_path):
    placed = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (2, 1, 1)], idfiles.ROWS)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    idfiles.write_assignments(placed, str(tmp_path / "a"))
    idfiles.write_idmaps(placed, 3, str(tmp_path / "b"))
    idfiles.write_locals(placed, str(tmp_path / "c"))
    assert rows(idfiles.read_assignments(spark, str(tmp_path / "a"))) == [(0, 0), (0, 1), (2, 1)]
    assert rows(idfiles.read_idmaps(spark, str(tmp_path / "b"))) == rows(placed) == rows(idfiles.read_locals(spark, str(tmp_path / "c")))
    asked = spark.createDataFrame([(1, 1), (9, 9)], "cid int, local_id long")
    assert {r["cid"]: r["global_id"] for r in idfiles.local_to_global(asked, placed).collect()} == {1: 2, 9: None}
    speed = spark.createDataFrame([(10, 0.9, 5.0), (20, 0.8, 4.0)], "L int, recall double, QPS double")
    idfiles.write_performance(speed, str(tmp_path / "perf"))
    assert [r["L"] for r in idfiles.read_performance(spark, str(tmp_path / "perf")).collect()] == [20, 10]
    (tmp_path / "deep_40.log").write_text("start\nMerge time: 12.5 s\n")
    assert rows(idfiles.read_merge_times(spark, str(tmp_path / "deep_40.log"))) == [("deep_40", 12.5)]


def test_stream_of_changes(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "table")
    put = lambda name, *rows: spark.createDataFrame(rows, upserts.CHANGES).coalesce(1).write.parquet(str(source / name))
    put("a", (1, [1.0], "upsert", 1), (2, [2.0], "upsert", 1), (1, [1.5], "upsert", 2))
    run = lambda: upserts.start(spark.readStream.schema(upserts.CHANGES).option("recursiveFileLookup", "true").parquet(str(source)), table, str(tmp_path / "checkpoint"), True).awaitTermination(120)
    assert run()
    put("b", (2, None, "delete", 2), (3, [3.0], "upsert", 1), (1, [0.0], "upsert", 1))
    assert run()
    got = {r["vec_id"]: (r["embedding"], r["deleted"]) for r in upserts.current(spark, table).collect()}
    assert got == {1: ([1.5], False), 2: (None, True), 3: ([3.0], False)}


def test_queries_agree_with_duckdb(spark, tmp_path):
    from vecweft.plans import oracle, queries, surface

    made, sql = queries.queries() | surface.queries(), oracle.oracle_sql()
    assert set(sql) <= set(made)
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    for name in ("knn_l2_exact", "knn_spaces", "range_search_capped", "multivector_search", "recall_at_k", "random_partition", "overlap_assign", "order_circle", "order_circulant", "degree_stats", "replace_deleted", "order_mst", "vector_slices", "id_files", "l2_bytes"):
        made[name](spark, SF).write.parquet(out := str(tmp_path / name))
        con.sql(f"create or replace table o as {sql[name]}")
        columns = ", ".join(f'"{c}"' for c in con.table("o").columns)
        got = f"(select {columns} from '{out}/*.parquet')"
        both = con.sql(f"select count(*) from ((select {columns} from o except all {got}) union all ({got} except all select {columns} from o))").fetchall()
        assert both == [(0,)], name


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["q_id", "rank", "vec_id", "dist"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_graph_files(spark, rows, tmp_path):
    from vecweft.operators import index as ann
    from vecweft.sources import graphfiles

    base = spark.createDataFrame([(i * 3, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<float>").withColumn("part_id", F.lit(0))
    settings = ann.Settings("l2", 4, 40)
    built = ann.build(base, settings).withColumn("deleted", F.col("vec_id") == 9).persist()
    path = str(tmp_path / "graph.bin")
    graphfiles.write_graph(built, path, settings)
    head = graphfiles.read_header(path)
    assert (head["count"], head["m"], head["max_m0"], head["vector"], head["record"]) == (300, 4, 8, 36, 36 + 32 + 8) and head["top"] >= 1
    back = graphfiles.read_graph(spark, path)
    plain = lambda df: {r["vec_id"]: (r["level"], r["deleted"], tuple(r["embedding"]), [sorted(x) for x in r["links"]]) for r in df.collect()}
    assert plain(back) == plain(built)
    queries = base.where("vec_id < 60").select("vec_id", "embedding")
    assert ann.search(back, queries, 5, 40).exceptAll(ann.search(built, queries, 5, 40)).count() == 0
    data = open(path, "rb").read()
    for wrong in (data[:-3], data + b"x", data[:50], data[:200]):
        open(path, "wb").write(wrong)
        with pytest.raises(Exception, match="cut off|too many|no header"):
            graphfiles.read_graph(spark, path).collect()


def test_storage_needs_a_shared_folder_on_a_cluster(spark, tmp_path):
    from types import SimpleNamespace

    from vecweft import storage

    none = SimpleNamespace(get=lambda key, default=None: None)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_dir(SimpleNamespace(conf=none, sparkContext=context))
    before = spark.conf.get(storage.BATCH_ROWS)
    table = storage.written(spark.range(5), "five", 2)
    assert table.count() == 5 and spark.conf.get(storage.BATCH_ROWS) == before
