"""Exact and near duplicates, and sharding."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vecweft.llm import exact_dedup, near_dedup, sharding


def test_exact_dedup_is_brute_force(docs, corpus):
    groups = defaultdict(list)
    for doc_id, text, *_ in corpus:
        groups[text or ""].append(doc_id)
    want = {(i, max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids}
    for hot_rows in (1, 3, 10_000):
        assert {tuple(r) for r in exact_dedup.exact_dedup(docs, hot_rows=hot_rows).collect()} == want
        kept = exact_dedup.drop_exact_copies(docs, hot_rows=hot_rows)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {max(ids) for ids in groups.values()} and kept.count() == len(groups)
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}


def test_exact_dedup_of_odd_tables(odd, nothing):
    found = exact_dedup.exact_dedup(odd).collect()
    assert len(found) == 5 and {(r["doc_id"], r["keep_id"], r["group_size"]) for r in found} == {(None, 7, 3), (7, 7, 3), (None, 8, 2), (8, 8, 2)}
    assert exact_dedup.exact_dedup(nothing).count() == 0
    assert sorted(exact_dedup.drop_exact_copies(odd).select("doc_id").collect()) == [(7,), (8,)]
    assert exact_dedup.drop_exact_copies(odd).schema == odd.schema and exact_dedup.drop_exact_copies(nothing).count() == 0


def test_copies_under_repeated_ids_and_any_columns(spark):
    rows = [(7, "a", 1), (7, "b", 2), (9, "b", 3), (7, "a", 4), (None, "c", 5), (None, "c", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, best int").withColumn("row", F.create_map(F.lit("k"), F.col("best")))
    for hot_rows in (1, 10_000):
        kept = exact_dedup.drop_exact_copies(docs, hot_rows=hot_rows)
        assert kept.columns == docs.columns and sorted((r["doc_id"] or 0, r["text"], r["best"]) for r in kept.collect()) == [(0, "c", 6), (7, "a", 4), (9, "b", 3)]
        assert all(r["row"] == {"k": r["best"]} for r in kept.collect())
    named = spark.createDataFrame([("x", "t"), ("y", "t")], "`the id` string, `a.b` string")
    assert exact_dedup.drop_exact_copies(named, "the id", "a.b").collect() == [("y", "t")]
    found = exact_dedup.exact_dedup(named.toDF("doc_id", "text")).collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in found} == {("x", "y", False), ("y", "y", True)}


def brute_components(rows, words, percent):
    sets, part = {}, {}
    for doc_id, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
        part[doc_id] = doc_id

    def root(x):
        return x if part[x] == x else root(part[x])

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = root(a), root(b)
                    part[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), root(i), root(i) == i) for i in sets}


def test_near_duplicates_are_brute_force(docs, corpus):
    assert {tuple(r) for r in near_dedup.near_duplicates(docs, words=4).collect()} == brute_components(corpus, 4, 80)


def test_a_group_of_near_copies_loses_no_link(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(220):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    want = brute_components(rows, 5, 80)
    assert 1 < len({r[2] for r in want}) < 200
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {tuple(r) for r in found.collect()} == want


def test_near_duplicates_of_odd_tables(odd, nothing):
    found = near_dedup.near_duplicates(odd).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in found) == [(-1, -1), (-1, 7), (7, 7), (7, 7), (8, 8)]
    assert near_dedup.near_duplicates(nothing).count() == 0
    assert near_dedup.drop_near_copies(odd).columns == odd.columns


def test_repeated_ids_lose_no_link(spark):
    w, z = (" ".join(f"{p}{i}" for i in range(60)) for p in "wz")
    rows = [(5, w), (5, z), (6, z + " extra"), (8, w + " extra"), (8, w + " extra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dedup.near_duplicates(docs, words=4).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(5, 5), (6, 5), (8, 5)} and len(found) == 5
    kept = near_dedup.drop_near_copies(docs, words=4).collect()
    assert sorted(kept) == sorted([(5, w), (5, z)])
    twice = spark.createDataFrame([(1, w, 1), (1, w, 2), (2, w + " x", 3), (None, z, 4), (None, z + " y", 5)], "doc_id long, text string, n int")
    assert sorted((r["doc_id"] or 0) for r in near_dedup.drop_near_copies(twice).collect()) == [0, 1]
    with pytest.raises(TypeError, match="integer ids"):
        near_dedup.near_duplicates(docs.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_cells_of_small_blocks_are_brute_force(spark, monkeypatch):
    for name, value in (("BLOCK", 1500), ("ROWS_AT_ONCE", 20), ("PAIRS_AT_ONCE", 64), ("FEW_WORDS", 1), ("PAIRS_A_TASK", 7)):
        monkeypatch.setattr(near_dedup, name, value)
    test_a_group_of_near_copies_loses_no_link(spark)


def test_near_dedup_sql(docs, corpus):
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [[r[0], r[1]] for r in corpus])
    assert set(con.sql(near_dedup.sql()).fetchall()) == brute_components(corpus, 4, 80)


def sequential_superminhash(elements):
    """Element by element, as published: a signature of the least step plus fraction of each slot."""
    k, step = near_dedup.SLOTS, near_dedup._STEP
    out = [None] * k
    mix = lambda x: int(near_dedup._mix(np.array([x], np.uint64))[0])
    for e in elements:
        deal = list(range(k))
        for j in range(k):
            x = mix((e + (j + 1) * step) % 2**64)
            at = j + ((x & 0xFFFFFFFF) * (k - j) >> 32)
            deal[j], deal[at] = deal[at], deal[j]
            value = x >> 32 | j << 32
            out[deal[j]] = value if out[deal[j]] is None else min(out[deal[j]], value)
    return out


def test_signatures(monkeypatch):
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**64, n, np.uint64)) for n in (1, 3, 40, 300)]
    want = [sequential_superminhash(s.tolist()) for s in sets]
    assert near_dedup.signatures(sets).tolist() == want
    monkeypatch.setattr(near_dedup, "ELEMENTS", 64)
    assert near_dedup.signatures(sets).tolist() == want
    both = [np.unique(rng.integers(0, 2**64, 500, np.uint64)) for _ in range(2)]
    mixed = near_dedup.signatures([np.union1d(both[0], both[1][:250]), both[0]])
    assert abs((mixed[0] == mixed[1]).mean() - 500 / 750) < 0.12


@pytest.mark.parametrize("a_task", [20, 500_000])
def test_components_of_chains(spark, monkeypatch, a_task):
    monkeypatch.setattr(near_dedup, "LINKS_A_TASK", a_task)
    chain = [(i + 1, i) for i in range(200)] + [(1000, 500), (500, 900)]
    found = near_dedup.components(spark.createDataFrame(chain, "a long, b long").repartition(6))
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(1, 201)} | {(900, 500), (1000, 500)}


def test_shards(docs, corpus):
    found = sharding.shard_report(docs).collect()
    texts = {r[0]: (r[1] or "").encode() for r in corpus}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in found} == {(i, len(t) + 16, zlib.crc32(t)) for i, t in texts.items()}
    for shard in range(40):
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    grown = {r["doc_id"]: r["shard"] for r in sharding.shuffle_shards(docs, 41).collect()}
    assert all(r["grown_shard"] == grown[r["doc_id"]] and r["grown_shard"] in (r["shard"], 40) for r in found)
    again = sharding.shard_report(docs.repartition(7)).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in found}


def fisher_yates(generator, n):
    out = []
    for i in range(n):
        bits = int(generator.randint(0, 2**32, dtype=np.uint32)) >> 1
        bound = i + 1
        if bound & (bound - 1) == 0:
            at = bound * bits >> 31
        else:
            while bits - bits % bound + bound - 1 >= 2**31:
                bits = int(generator.randint(0, 2**32, dtype=np.uint32)) >> 1
            at = bits % bound
        out.append(None)
        out[i] = out[at]
        out[at] = i
    return out


def test_buckets_are_fisher_yates_shuffled(spark):
    docs = spark.range(37).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    found = sharding.shuffle_shards(docs, 1).orderBy("slot").collect()
    seed = sharding.SEED + 2
    assert [r["doc_id"] for r in found] == fisher_yates(np.random.RandomState([seed >> 32, seed & 0xFFFFFFFF]), 37)


def test_a_frequent_id_is_dealt_over_buckets(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    found = sharding.shuffle_shards(docs, 5, bucket_bytes=2000).collect()
    assert len({r["shard"] for r in found if r["doc_id"] == 7}) == 1 and sorted(r["text"] for r in found) == sorted(r["text"] for r in docs.collect())
    for shard in range(5):
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in found)))
    hot = next(r["shard"] for r in found if r["doc_id"] == 7)
    places = [r["slot"] for r in found if r["doc_id"] == 7]
    assert max(places) - min(places) > 900 and hot in range(5)


def test_shards_of_clashing_columns(spark):
    names = ["doc_id", "text", "__top", "__shard", "task", "bucket", "id", "one", "row", "k", "a.b", "first", "n"]
    docs = spark.createDataFrame([tuple([i, f"t{i}", *range(len(names) - 2)]) for i in range(20)], ", ".join(f"`{c}` {'string' if c == 'text' else 'long'}" for c in names))
    docs = docs.withColumn("m", F.create_map(F.lit("x"), F.col("doc_id")))
    found = sharding.shuffle_shards(docs, 3)
    assert found.columns == [*names, "m", "shard", "slot", "grown_shard"] and found.count() == 20
    assert {(r["doc_id"], r["text"], r["m"]["x"]) for r in found.collect()} == {(i, f"t{i}", i) for i in range(20)}


def test_shards_of_odd_tables(odd, nothing, tmp_path):
    found = sharding.shuffle_shards(odd, 4, bucket_bytes=20)
    assert found.count() == 5 and found.columns.count("shard") == 1
    assert sharding.shuffle_shards(nothing).count() == 0
    sharding.write_shards(found, str(tmp_path / "shards"))
    assert odd.sparkSession.read.parquet(str(tmp_path / "shards")).count() == 5
