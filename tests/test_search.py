import numpy as np
import pytest
from pyspark.sql import functions as F

from vecweft.functions import vector as V
from vecweft.operators import knn, metrics, tables

#: Golden vectors; distances from the last one, sorted.
FIVE = [[1.0, 0, 0], [0, 1, 0], [0, 0, 1], [1, 0, 1], [1, 1, 1]]
GOLDEN = {"l2": [0, 1, 2, 2, 2], "ip": [-2, -1, 0, 0, 0], "cosine": [0, 0.1835, 0.423, 0.423, 0.423]}
SCHEMA = "vec_id long, embedding array<float>"


def frame(spark, rows, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in r]) for i, r in enumerate(rows)], SCHEMA)


def brute(queries, base, k, space="l2"):
    q, b = np.asarray(queries, np.float64), np.asarray(base, np.float64)
    if space == "cosine":
        q, b = V.unit(q), V.unit(b)
    d = ((q[:, None] - b[None]) ** 2).sum(-1) if space == "l2" else 1 - q @ b.T
    order = np.lexsort((np.broadcast_to(np.arange(len(b)), d.shape), d), axis=1)[:, :k]
    return order, np.take_along_axis(d, order, 1)


@pytest.fixture(scope="module")
def rows():
    return np.random.default_rng(47).random((600, 16)).astype(np.float32)


@pytest.mark.parametrize("space", V.SPACES)
@pytest.mark.parametrize("pad", [0, 5])
def test_golden_distances(spark, space, pad):
    wide = [[0.0] * pad + r + [0.0] * pad for r in FIVE]
    base = frame(spark, wide)
    found = [r["dist"] for r in knn.knn(base.where("vec_id = 4"), base, 5, space).orderBy("rank").collect()]
    assert np.abs(np.array(found) - GOLDEN[space]).mean() < 1e-3
    pairs = base.alias("a").join(base.where("vec_id = 4").alias("b"), F.lit(True))
    columns = sorted(r[0] for r in pairs.select(V.distance(F.col("a.embedding"), F.col("b.embedding"), space)).collect())
    assert np.abs(np.array(columns) - GOLDEN[space]).mean() < 1e-3


@pytest.mark.parametrize("space", V.SPACES)
def test_knn_is_brute_force(spark, rows, space):
    base = frame(spark, rows).repartition(5)
    found = knn.knn(base.where("vec_id < 40"), base, 7, space).orderBy("q_id", "rank").collect()
    want, dist = brute(rows[:40], rows, 7, space)
    assert [r["vec_id"] for r in found] == want.ravel().tolist()
    assert np.abs(np.array([r["dist"] for r in found]) - dist.ravel()).max() < 1e-9


def test_ties_go_by_id_even_if_all_vectors_are_equal(spark):
    base = frame(spark, [[1.0, 2.0]] * 300).repartition(7)
    found = knn.knn(base.where("vec_id = 200"), base, 4, exclude_self=True).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [0, 1, 2, 3]


def test_filters_deletes_and_strictness(spark, rows):
    base = frame(spark, rows)
    asked = base.where("vec_id < 5")
    assert {r["vec_id"] % 3 for r in knn.knn(asked, base.where("vec_id % 3 = 0"), 5).collect()} == {0}
    assert knn.knn(asked, base.where("false"), 5).count() == 0
    gone = base.where("vec_id < 300").select("vec_id")
    assert knn.knn(asked, tables.delete(base, gone), 5).agg(F.min("vec_id")).first()[0] >= 300
    allowed = tables.keep_only(base, spark.createDataFrame([(26,), (39,), (52,)], "vec_id long"))
    assert knn.knn(asked, allowed, 10).count() == 15
    with pytest.raises(ValueError, match="fewer than"):
        knn.knn(asked, allowed, 10, strict=True)
    with pytest.raises(ValueError):
        knn.knn(asked, base, 3, "manhattan")


def test_null_and_empty_tables(spark):
    odd = spark.createDataFrame([(None, [1.0]), (1, None), (2, [3.0])], SCHEMA)
    assert [tuple(r) for r in knn.knn(odd, odd, 2).collect()] == [(2, 1, 2, 0.0)]
    empty = spark.createDataFrame([], SCHEMA)
    assert knn.knn(empty, odd, 2).count() == 0 and knn.radius(odd, empty, 1.0).count() == 0


def test_radius(spark, rows):
    base = frame(spark, rows).repartition(4)
    found = {(r["q_id"], r["vec_id"]) for r in knn.radius(base.where("vec_id < 20"), base, 1.0).collect()}
    d = ((rows[:20, None].astype(float) - rows[None].astype(float)) ** 2).sum(-1)
    assert found == set(zip(*(x.tolist() for x in np.nonzero(d <= 1.0)), strict=True))
    capped = knn.radius(base.where("vec_id < 20"), base, 1.0, max_num=3)
    assert capped.agg(F.max("rank")).first()[0] <= 3
    assert {(r[0], r[1]) for r in knn.radius(base.where("vec_id < 20"), base, 1e-4).select("q_id", "vec_id").collect()} == {(i, i) for i in range(20)}


def test_document_search_is_the_longest_prefix(spark, rows):
    base = frame(spark, rows).withColumn("doc_id", (F.col("vec_id") * 7 % 50).cast("int")).repartition(3)
    found = knn.document_search(base.where("vec_id < 10"), base, 4).orderBy("q_id", "rank").collect()
    order, _ = brute(rows[:10], rows, len(rows))
    want = []
    for q, near in enumerate(order):
        docs = set()
        for v in near.tolist():
            docs.add(v * 7 % 50)
            if len(docs) > 4:
                break
            want.append((q, v))
    assert [(r["q_id"], r["vec_id"]) for r in found] == want


def test_recall(spark):
    rows = lambda *x: spark.createDataFrame(x, "q_id long, rank int, vec_id long")
    truth, found = rows((1, 1, 5), (1, 2, 6), (2, 1, 7), (2, 2, 8)), rows((1, 1, 6), (1, 2, 9))
    assert metrics.recall(found, truth, 2).first()["recall"] == 0.25
    assert metrics.self_recall(rows((1, 1, 1), (2, 1, 3))).first()["recall"] == 0.5


def test_columns(spark):
    df = spark.createDataFrame([([3, 4], [0, 255])], "a array<int>, b array<int>")
    assert df.select(V.l2_bytes(F.col("a"), F.col("b"))).first()[0] == 9 + 251 * 251
    assert df.select(V.normalise(F.col("a"))).first()[0] == pytest.approx([0.6, 0.8])
    assert df.select(V.normalise_rows(F.array(F.lit(0.0)))).first()[0] == [0.0]
    levels = spark.range(20000).select(V.level_of(F.col("id"), 16).alias("l")).groupBy("l").count().collect()
    assert 0.9 < next(r["count"] for r in levels if r["l"] == 0) / 20000 < 0.97


def test_table_changes(spark):
    base = spark.createDataFrame([(i, float(i), False) for i in range(5)], "vec_id long, x double, deleted boolean")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "vec_id long")
    marked = tables.mark_deleted(base, ids(1, 3))
    assert {r["vec_id"] for r in marked.where("deleted").collect()} == {1, 3}
    assert not tables.unmark_deleted(marked, ids(1)).where("deleted and vec_id = 1").count()
    for wrong in (lambda: tables.mark_deleted(marked, ids(1)), lambda: tables.mark_deleted(base, ids(9)), lambda: tables.unmark_deleted(base, ids(1))):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(KeyError):
        tables.get_items(marked, ids(3))
    assert tables.get_items(marked, ids(0, 2)).count() == 2
    replaced = tables.replace_deleted(marked, spark.createDataFrame([(10, 0.5)], "vec_id long, x double"))
    assert sorted(r["vec_id"] for r in replaced.collect()) == [0, 2, 3, 4, 10]
    changed = tables.upsert(base.withColumn("version", F.lit(1)), base.where("vec_id = 2").withColumns({"x": F.lit(9.0), "version": F.lit(1)}))
    assert {r["vec_id"]: r["x"] for r in changed.collect()}[2] == 9.0 and changed.count() == 5
