import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecweft.operators import graphs, index, knn, merge, metrics, order, partition

SCHEMA = "vec_id long, embedding array<float>"
SETTINGS = index.Settings("l2", m=12, ef_construction=80)


@pytest.fixture(scope="module")
def rows():
    return np.random.default_rng(1).random((900, 12)).astype(np.float32)


@pytest.fixture(scope="module")
def base(spark, rows):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], SCHEMA).cache()


@pytest.fixture(scope="module")
def built(spark, base):
    return index.build(partition.random_partition(base, 3), SETTINGS).persist()


def test_random_partition(spark, base):
    parts = partition.random_partition(base, 7).select("vec_id", "part_id", "local_id", "global_id").collect()
    sizes = [sum(r["part_id"] == p for r in parts) for p in range(7)]
    assert sizes == [129] * 4 + [128] * 3
    assert sorted(r["global_id"] for r in parts) == list(range(900))
    assert all(sorted(r["local_id"] for r in parts if r["part_id"] == p) == list(range(sizes[p])) for p in range(7))
    assert parts == partition.random_partition(base.repartition(5), 7).select("vec_id", "part_id", "local_id", "global_id").collect() or {tuple(r) for r in parts} == {tuple(r) for r in partition.random_partition(base.repartition(5), 7).select("vec_id", "part_id", "local_id", "global_id").collect()}
    with pytest.raises(ValueError):
        partition.random_partition(base, 1)


def test_centroids_and_overlap(spark, base, rows):
    first = partition.first_centroids(base, 5)
    near = partition.nearest_centroids(base, first, 2).collect()
    d = ((rows[:, None].astype(float) - np.array(first)[None]) ** 2).sum(-1)
    want = np.argsort(d, axis=1, kind="stable")[:, :2]
    assert {(r["vec_id"], r["rank"], r["cid"]) for r in near} == {(i, k + 1, int(want[i, k])) for i in range(900) for k in (0, 1)}
    new = partition.update_centroids(base, first)
    assert np.allclose(new, [rows[want[:, 0] == c].astype(float).mean(0) for c in range(5)])
    cost = lambda c: ((rows[:, None].astype(float) - np.array(c)[None]) ** 2).sum(-1).min(1).sum()
    assert cost(partition.kmeans(base, 5, 5)) < cost(first)
    placed = partition.overlap_assign(base, first)
    for cid in range(5):
        mine = placed.where(F.col("cid") == cid).orderBy("global_id").collect()
        assert [r["local_id"] for r in mine] == list(range(len(mine)))
    assert [r["n"] for r in partition.partition_sizes(placed.where("cid <> 2"), 5).orderBy("cid").collect()][2] == 0


def test_diversified_is_the_rule(rows):
    for node in range(20):
        d = ((rows.astype(float) - rows[node].astype(float)) ** 2).sum(1)
        near = [i for i in np.argsort(d, kind="stable") if i != node][:40]
        kept = []
        for c in near:
            if len(kept) < 8 and all(((rows[s].astype(float) - rows[c].astype(float)) ** 2).sum() >= d[c] for s in kept):
                kept.append(c)
        got = graphs.diversified(d[near], rows[near].astype(float), 8, "l2")
        assert [near[g] for g in got] == kept
    assert graphs.diversified(np.arange(3.0), rows[:3], 8, "l2") == [0, 1, 2]


def test_graph_has_no_violations(spark, base, built):
    links = index.edges(built)
    found = {r["rule"]: r["violations"] for r in metrics.integrity(links, base).collect()}
    assert found == dict.fromkeys(("unknown_node", "self_link", "repeated_link", "unreached_node"), 0)
    assert metrics.degrees(links, base).first()["max_out"] <= 2 * SETTINGS.m
    assert built.agg(F.max("level")).first()[0] >= 1


def test_search_recall_and_self_recall(spark, base, built):
    truth = knn.knn(base.where("vec_id % 20 = 0"), base, 10)
    found = index.search(built, base.where("vec_id % 20 = 0"), 10, 80)
    assert metrics.recall(found, truth, 10).first()["recall"] > 0.95
    assert metrics.self_recall(index.search(built, base.where("vec_id % 20 = 0"), 1, 10)).first()["recall"] > 0.99


def test_filtered_and_deleted_are_not_returned(spark, base, built):
    marked = built.withColumn("deleted", F.col("vec_id") % 10 == 0)
    found = index.search(marked, base.where("vec_id % 30 = 0"), 5, 80, allowed=F.col("vec_id") % 2 == 0).collect()
    assert found and all(r["vec_id"] % 2 == 0 and r["vec_id"] % 10 for r in found)


def test_beams_of_many_queries_are_those_of_each(rows):
    ids = np.arange(len(rows)) * 7 % 900
    graph = graphs.Graph.build(ids, rows.astype(float), "l2", 8, 40, np.zeros(len(rows), np.int64))
    starts = np.stack([np.arange(60), np.arange(60) * 3, np.arange(60)], 1)
    places, dist = graph.beams(rows[:60].astype(float), 20, starts)
    graph.shown = np.ones(len(rows), bool)
    again, same = graph.beams(rows[:60].astype(float), 20, starts)
    assert (places == again).all() and np.allclose(dist, same)


def test_links_survive_the_table(rows):
    levels = (np.arange(len(rows)) % 50 == 0).astype(np.int64)
    graph = graphs.Graph.build(np.arange(len(rows)), rows.astype(float), "l2", 8, 40, levels)
    back = graphs.Graph.from_columns(graph.ids, graph.rows, graph.levels, graph.nested_links(), "l2")
    assert all({tuple(sorted(a[a >= 0])) for a in x} == {tuple(sorted(b[b >= 0])) for b in y} for x, y in zip(graph.links, back.links, strict=True))


def test_inserted_and_updated_nodes_are_found(spark, base, built, rows):
    new = spark.createDataFrame([(900 + i, r.tolist()) for i, r in enumerate(np.random.default_rng(5).random((90, 12)).astype(np.float32))], SCHEMA)
    moved = base.where("vec_id % 30 = 7").withColumn("embedding", F.transform("embedding", lambda x: 1 - x))
    changes = new.unionByName(moved)
    grown = index.add(built.withColumn("deleted", F.col("vec_id") == 7), changes, SETTINGS).persist()
    now = base.join(moved, "vec_id", "left_anti").unionByName(changes)
    assert grown.count() == 990 and not grown.where("deleted").count()
    violations = {r["rule"]: r["violations"] for r in metrics.integrity(index.edges(grown), now).collect()}
    assert not violations["self_link"] and not violations["repeated_link"] and not violations["unknown_node"] and metrics.degrees(index.edges(grown), now).first()["max_out"] <= 2 * SETTINGS.m
    assert metrics.recall(index.search(grown, changes, 10, 80), knn.knn(changes, now, 10), 10).first()["recall"] > 0.95
    asked = now.where("vec_id % 20 = 0")
    assert metrics.recall(index.search(grown, asked, 10, 80), knn.knn(asked, now, 10), 10).first()["recall"] > 0.95
    untouched = index.add(built, new.limit(0), SETTINGS)
    assert untouched.count() == 900 and index.add(built.limit(0), new, SETTINGS).count() == 90


def test_radius_and_documents_over_the_graph(spark, base, built):
    asked = base.where("vec_id % 45 = 0")
    exact, found = knn.radius(asked, base, 0.6), index.search_radius(built, asked, 0.6)
    want, got = ({(r["q_id"], r["vec_id"]) for r in x.collect()} for x in (exact, found))
    assert got <= want and len(got) > 0.95 * len(want)
    assert index.search_radius(built, asked, 0.6, max_num=2).groupBy("q_id").count().agg(F.max("count")).first()[0] <= 2
    docs = base.withColumn("doc_id", F.col("vec_id") % 40)
    want = {(r["q_id"], r["vec_id"]) for r in knn.document_search(asked, docs, 4).collect()}
    got = {(r["q_id"], r["vec_id"]) for r in index.search_documents(built, docs, asked, 4, 30).collect()}
    assert len(got & want) > 0.95 * len(want)


def test_cost_grows_with_the_beam(spark, base, built):
    asked = base.where("vec_id % 90 = 0")
    few, many = (index.search_cost(built, asked, 1, ef).agg(F.avg("hops").alias("h"), F.avg("distances").alias("d")).first() for ef in (10, 80))
    assert 3 * 10 <= few["h"] < many["h"] and few["d"] < many["d"] <= 3 * 900
    curve = metrics.sweep(lambda ef: index.search(built, asked, 10, ef), knn.knn(asked, base, 10), 10, (10, 80))
    assert [c[0] for c in curve] == [10, 80] and curve[0][1] <= curve[1][1] and all(c[2] > 0 for c in curve)


def test_blocks_by_degree_cover_and_merges_stop_early(spark, base, built):
    found = index.blocks(built, by_degree=True).collect()
    assert sorted(r["member"] for r in found) == list(range(900))
    assert all((r["member"] in {x["bid"] for x in found}) == (r["member"] == r["bid"]) for r in found)
    pairs = order.merge_order(spark, "pairwise", 3)
    every, some = merge.cross_candidates(built, pairs), merge.cross_candidates(built, pairs, stop_ratio=0.5)
    assert 0 < some.count() < every.count() and some.exceptAll(every).count() == 0


def test_blocks_cover_each_node_once(spark, base, built):
    found = index.blocks(built).collect()
    assert sorted(r["member"] for r in found) == list(range(900))
    centres = {r["bid"] for r in found}
    assert all((r["member"] in centres) == (r["member"] == r["bid"]) for r in found)
    assert len(centres) < 700


@pytest.mark.parametrize("method", ["cross", "sliding"])
def test_merged_graph_is_searchable_as_one(spark, base, built, method):
    merged = merge.merge(built, order.merge_order(spark, "pairwise", 3), method, SETTINGS.m).persist()
    assert {r[0] for r in merged.select("part_id").distinct().collect()} == {0, 1, 2} and merged.count() == 900
    crossing = index.edges(merged).join(built.select(F.col("vec_id").alias("src"), F.col("part_id").alias("p")), "src").join(built.select(F.col("vec_id").alias("dst"), F.col("part_id").alias("q")), "dst")
    assert crossing.where("p <> q").count() > 900
    asked = base.where("vec_id % 20 = 0")
    truth = knn.knn(asked, base, 10)
    assert metrics.recall(index.search(merge.as_one(merged), asked, 10, 80), truth, 10).first()["recall"] > 0.95
    for probes in (1, 3):
        assert metrics.recall(index.search_linked(merged, asked, 10, 80, probes=probes), truth, 10).first()["recall"] > 0.95
    assert index.search_linked(merged, asked.limit(0), 10).count() == 0 and index.search_linked(merged.limit(0), asked, 10).count() == 0
    assert metrics.degrees(index.edges(merged), base).first()["max_out"] <= 2 * SETTINGS.m
    violations = {r["rule"]: r["violations"] for r in metrics.integrity(index.edges(merged), base).collect()}
    assert not violations["self_link"] and not violations["repeated_link"] and not violations["unknown_node"]


def test_concat_keeps_parts_apart_and_overlap_merge_joins(spark, built):
    flat = merge.concat(built)
    assert flat.agg(F.max(F.size("links"))).first()[0] == 1
    links = spark.createDataFrame([(1, 2), (1, 3), (1, 2), (2, 2), (1, 4)], "src long, dst long")
    joined = merge.overlap_merge(links, m=1).collect()
    assert len(joined) == 2 and len({r["dst"] for r in joined}) == 2


def hops(pairs, m):
    near = {i: {j for p in pairs for j in p if i in p and j != i} for i in range(m)}
    reach = lambda i: {i} | near[i] | {k for j in near[i] for k in near[j]}
    return near, reach


def test_orders(spark):
    cost = np.random.default_rng(3).random((20, 20))
    cost = ((cost + cost.T) / 2).tolist()
    tree = order.minimum_spanning_tree(cost)
    assert len(tree) == 19 and len(order.path(9)) == 8 and len(order.petersen(10)) == 35
    small = [r[:6] for r in cost[:6]]
    total = lambda pairs: sum(small[i][j] for i, j in pairs)

    def connects(pairs):
        parts = [{i} for i in range(6)]
        for i, j in pairs:
            a, b = next(p for p in parts if i in p), next(p for p in parts if j in p)
            if a is not b:
                parts.remove(b)
                a |= b
        return len(parts) == 1

    best = min(total(p) for p in itertools.combinations(itertools.combinations(range(6), 2), 5) if connects(p))
    assert total(order.minimum_spanning_tree(small)) == pytest.approx(best)
    pairs = order.two_hop(cost, 9)
    near, reach = hops(pairs, 20)
    assert all(len(reach(i)) == 20 for i in range(20)) and len(pairs) <= 90
    for m, n in ((8, 28), (23, 253), (24, 252), (25, 275), (30, 375), (50, 825), (100, 2050)):
        assert order.circulant(spark, m).count() == n
    assert order.pairwise(spark, 5).count() == 10
    for wrong in (lambda: order.petersen(9), lambda: order.merge_order(spark, "random", 5), lambda: order.merge_order(spark, "mst", 5)):
        with pytest.raises(ValueError):
            wrong()
    assert order.average_degree([(0, 1), (1, 2)], 3) == pytest.approx(4 / 3)
