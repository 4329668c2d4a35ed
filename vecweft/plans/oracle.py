"""DuckDB SQL of the registered queries over ``embeddings``."""

from __future__ import annotations

#: Clusters, and partitions, of the registered queries.
M, PARTS = 6, 7

L2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
IP = "(1 - list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)))"
UNIT = "list_transform({a}, lambda x: x::DOUBLE / (sqrt(list_sum(list_transform({a}, lambda y: y::DOUBLE * y::DOUBLE))) + 1e-30))"
PLAIN, STRETCHED = "embeddings", "(SELECT vec_id, label, list_transform(embedding, lambda x: (x * (1 + vec_id % 5)::FLOAT)::FLOAT) AS embedding FROM embeddings)"
KEY = "md5(vec_id::VARCHAR || '-42')"


def dist(space: str, a: str = "q.embedding", b: str = "b.embedding") -> str:
    if space == "cosine":
        return IP.format(a=UNIT.format(a=a), b=UNIT.format(a=b))
    return (L2 if space == "l2" else IP).format(a=a, b=b)


def knn(space: str = "l2", where: str = "true", k: int = 10, table: str = PLAIN, own: bool = False) -> str:
    return f"""
SELECT q_id, rank, vec_id, round(d, 6) AS dist FROM (
  SELECT q_id, vec_id, d, row_number() OVER (PARTITION BY q_id ORDER BY d, vec_id)::INT AS rank FROM (
    SELECT q.vec_id AS q_id, b.vec_id AS vec_id, {dist(space)} AS d FROM {table} q, {table} b
    WHERE q.vec_id % 50 = 0 {"" if own else "AND q.vec_id <> b.vec_id"} AND ({where})))
WHERE rank <= {k}"""


PAIRS = f"(SELECT q.vec_id AS q_id, b.vec_id AS vec_id, b.label AS doc_id, {dist('l2')} AS d FROM embeddings q, embeddings b WHERE q.vec_id % 50 = 0)"
RADIUS = f"SELECT q_id, (row_number() OVER (PARTITION BY q_id ORDER BY d, vec_id))::INT AS rank, vec_id, round(d, 6) AS dist FROM {PAIRS} WHERE d <= 1.4"
DOCS = f"""
SELECT q_id, (row_number() OVER (PARTITION BY q_id ORDER BY d, vec_id))::INT AS rank, vec_id, doc_id::BIGINT AS doc_id, round(d, 6) AS dist FROM (
  SELECT *, sum(new) OVER (PARTITION BY q_id ORDER BY d, vec_id) AS docs FROM (
    SELECT *, (row_number() OVER (PARTITION BY q_id, doc_id ORDER BY d, vec_id) = 1)::INT AS new FROM {PAIRS}))
WHERE docs <= 3"""
CENTROIDS = f"(SELECT cid, embedding FROM (SELECT (row_number() OVER (ORDER BY {KEY}, vec_id) - 1)::INT AS cid, embedding FROM embeddings) WHERE cid < {M})"
NEAR = f"""(SELECT vec_id, cid, d, (row_number() OVER (PARTITION BY vec_id ORDER BY d, cid))::INT AS rank, e AS embedding
  FROM (SELECT b.vec_id, q.cid, {dist('l2')} AS d, b.embedding AS e FROM {CENTROIDS} q, embeddings b))"""
OVERLAP = f"SELECT vec_id AS global_id, cid, rank, row_number() OVER (PARTITION BY cid ORDER BY vec_id) - 1 AS local_id FROM {NEAR} WHERE rank <= 2"
SPLIT = f"""(SELECT vec_id, label, embedding, (ntile({PARTS}) OVER (ORDER BY {KEY}, vec_id) - 1)::INT AS part_id,
  row_number() OVER (ORDER BY {KEY}, vec_id) - 1 AS global_id FROM embeddings)"""
GRAPH = f"""(SELECT part_id, src, dst, d, (row_number() OVER (PARTITION BY src ORDER BY d, dst))::INT AS rank FROM (
  SELECT q.part_id, q.vec_id AS src, b.vec_id AS dst, {dist('l2')} AS d FROM {SPLIT} q JOIN {SPLIT} b ON q.part_id = b.part_id AND q.vec_id <> b.vec_id) QUALIFY rank <= 10)"""


def shuffled(m: int) -> str:
    return f"(SELECT (row_number() OVER (ORDER BY md5(i::VARCHAR || '-42')) - 1)::INT AS pos, i::INT AS i FROM range({m}) t(i))"


def _rows(pairs: list[tuple[int, int]]) -> str:
    return ", ".join(f"({n}, {a}, {b})" for n, (a, b) in enumerate(pairs))


#: The chords of the ring of 8, and the links of ten partitions.
CHORDS_OF_8 = [(0, 2), (1, 3), (2, 4), (3, 5), (4, 6), (5, 7), (6, 0), (7, 1), (0, 4), (1, 5), (2, 6), (3, 7)]
LINKS_OF_10 = [
    (0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (0, 2), (1, 3), (2, 4), (3, 0), (4, 1), (0, 6), (1, 7), (2, 8), (3, 9), (4, 5),
    (5, 7), (7, 9), (9, 6), (6, 8), (8, 5), (5, 6), (6, 7), (7, 8), (8, 9), (9, 5), (5, 1), (6, 2), (7, 3), (8, 4), (9, 0),
    (0, 5), (1, 6), (2, 7), (3, 8), (4, 9),
]

FLOATS = "list_sum(list_transform({e}, lambda x: x::DOUBLE))"
WHOLE = "list_sum(list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 127.5)))::DOUBLE"
FACTS = (
    "search finds the nearest", "filtered search returns only what is allowed", "filtered search finds the nearest allowed",
    *(f"{m} merge: {what}" for m in ("cross", "sliding") for what in ("recall across links", "recall as one", "no broken links", "degrees bounded")),
    "blocks cover each vector once", "more members than centres are not lost", "concatenation links nothing across", "k-means lowers the cost",
    "radius search over the graph", "search explores its beam and computes few distances twice", "search after insertion",
)


def totals(name: str, total: str = FLOATS.format(e="embedding"), source: str = "embeddings", row: str = "vec_id") -> str:
    return f"SELECT '{name}' AS format, {row} AS vec_id, len(embedding)::INT AS dim, round({total}, 4) AS total FROM {source}"


#: Edges are in the least spanning tree if no way of cheaper edges joins their ends: the least largest edge of a way, as Floyd and Warshall have it.
TREE = f"""WITH RECURSIVE c AS (SELECT cid, embedding FROM (SELECT (row_number() OVER (ORDER BY {KEY}, vec_id) - 1)::INT AS cid, embedding FROM embeddings) WHERE cid < 24),
  cost AS (SELECT q.cid AS i, b.cid AS j, {dist('l2')} AS d FROM c q, c b),
  ways AS (SELECT 0 AS k, i, j, d FROM cost UNION ALL
    SELECT w.k + 1, w.i, w.j, least(w.d, greatest(a.d, b.d)) FROM ways w JOIN ways a ON a.k = w.k AND a.i = w.i AND a.j = w.k JOIN ways b ON b.k = w.k AND b.i = w.k AND b.j = w.j WHERE w.k < 24)
  SELECT (row_number() OVER (ORDER BY c.i, c.j) - 1)::INT AS step, c.i, c.j FROM cost c JOIN ways w ON w.k = 24 AND w.i = c.i AND w.j = c.j WHERE c.i < c.j AND c.d <= w.d"""


def surface_sql() -> dict[str, str]:
    answers = f"""SELECT * FROM (VALUES ('lazy_count', 0.0), ('lazy_items', 0), ('lazy_found', 0), ('max_elements', 1000000), ('M', 8), ('ef', 64), ('ef_construction', 64), ('deleted_found', 0),
        ('itself_first', 9), ('as_before', 0), ('slot_gone', 0), ('item', 2), ('resized', 2000000), ('saved_bytes', 1)) v(name, value)
        UNION ALL SELECT 'count', count(*)::DOUBLE FROM embeddings WHERE vec_id < 400 UNION ALL SELECT 'ids', sum(vec_id)::DOUBLE FROM embeddings WHERE vec_id < 400
        UNION ALL SELECT n, c FROM (SELECT count(*)::DOUBLE AS c FROM embeddings WHERE vec_id < 400), (VALUES ('count_replaced'), ('pickled'), ('copied')) v(n)"""
    return {
        "vector_files": " UNION ALL ".join([*(totals(f) for f in (".fvecs", ".fbin")), *(totals(f, WHOLE) for f in (".ivecs", ".ibin", ".bvecs", ".u8bin"))]),
        "vector_slices": f"{totals('slice')} WHERE vec_id >= 100 AND vec_id < 150 UNION ALL {totals('clamped')} WHERE vec_id >= 450 UNION ALL {totals('raw')}",
        "truth_files": f"SELECT q_id // 50 AS q_id, rank, vec_id, round(dist, 4) AS dist FROM ({knn(own=True)})",
        "partition_files": f"{totals('x', source=SPLIT, row='row_number() OVER (PARTITION BY part_id ORDER BY global_id) - 1').replace(chr(39) + 'x' + chr(39), 'part_id::VARCHAR')} UNION ALL {totals('all', source=SPLIT, row='global_id')}",
        "id_files": f"SELECT 'assignments' AS file, global_id, cid, NULL::BIGINT AS local_id FROM ({OVERLAP}) UNION ALL SELECT f, global_id, cid, local_id FROM ({OVERLAP}), (VALUES ('idmaps'), ('locals')) v(f)",
        "local_to_global": f"SELECT (w.i % 7)::INT AS cid, w.i AS local_id, o.global_id FROM range(20) w(i) LEFT JOIN ({OVERLAP}) o ON o.cid = w.i % 7 AND o.local_id = w.i",
        "measurement_files": "SELECT 'curve' AS file, vec_id::INT AS key, vec_id % 5 / 4.0::DOUBLE AS recall, 100.0::DOUBLE - vec_id AS value FROM embeddings WHERE vec_id < 20 UNION ALL SELECT 'log', 0, NULL, 12.5",
        "timing": "SELECT round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS stddev FROM events WHERE value IS NOT NULL",
        "flat_index_calls": knn(where="b.vec_id % 3 = 0 AND b.vec_id <> 6", own=True),
        "index_calls": answers,
        "stream_upserts": "SELECT vec_id, CASE WHEN vec_id % 10 = 3 THEN 3 WHEN vec_id % 7 = 0 THEN 2 ELSE 1 END::BIGINT AS version, vec_id % 10 = 3 AS deleted, CASE WHEN vec_id % 10 <> 3 THEN round(CASE WHEN vec_id % 7 = 0 THEN -1 ELSE 1 END * list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) END AS total FROM embeddings",
        "normalize_rows": """SELECT vec_id, (pos - 1)::INT AS "at", round(e[pos]::DOUBLE / CASE WHEN n = 0 THEN 1 ELSE n END, 5) + 0.0::DOUBLE AS x FROM (SELECT vec_id, e, unnest(range(1, len(e) + 1)) AS pos, sqrt(list_sum(list_transform(e, lambda y: y::DOUBLE * y::DOUBLE))) AS n
            FROM (SELECT vec_id, list_transform(embedding, lambda x: (x * (vec_id % 5)::FLOAT)::FLOAT) AS e FROM embeddings))""",
        "largest_partition": f"SELECT max(n) AS n FROM (SELECT count(*) AS n FROM ({OVERLAP}) GROUP BY cid)",
        "order_degree": "SELECT 2 * count(*) / 30::DOUBLE AS degree FROM (SELECT DISTINCT least(a.i, (a.i + d.d) % 30) AS i, greatest(a.i, (a.i + d.d) % 30) AS j FROM range(30) a(i), (SELECT unnest(range(1, 13)) AS d UNION SELECT 15) d)",
        "knn_strict": knn(own=True),
        "approximate_facts": "SELECT fact, true AS holds FROM (VALUES " + ", ".join(f"('{f}')" for f in FACTS) + ") v(fact)",
        "order_mst": TREE,
    }


def oracle_sql() -> dict[str, str]:
    spaces = " UNION ALL ".join(f"SELECT *, '{s}' AS space FROM ({knn(s, table=STRETCHED)})" for s in ("l2", "ip", "cosine"))
    return surface_sql() | {
        "knn_l2_exact": knn(),
        "knn_ip_exact": knn("ip"),
        "knn_cosine_exact": knn("cosine"),
        "knn_spaces": spaces,
        "knn_filtered": knn(where="b.label = 3"),
        "knn_divisible": knn(where="b.vec_id % 2 = 0"),
        "knn_allowlist_semi": knn(where="b.vec_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0)"),
        "knn_excl_deleted_anti": knn(where="b.vec_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 10 = 3)"),
        "range_search": RADIUS,
        "range_search_capped": f"SELECT * FROM ({RADIUS}) WHERE rank <= 5",
        "multivector_search": DOCS,
        "multivector_docs": f"SELECT q_id, count(DISTINCT doc_id) AS docs, count(*) AS n FROM ({DOCS}) GROUP BY q_id",
        "self_recall": f"SELECT count(*) AS queries, avg((q_id = vec_id)::INT::DOUBLE) AS recall FROM ({knn(k=1, own=True)})",
        "recall_at_k": f"SELECT t.q_id, count(f.vec_id) AS hits, count(f.vec_id) / 10.0::DOUBLE AS recall FROM ({knn(own=True)}) t LEFT JOIN ({knn(where='b.vec_id % 2 = 0', own=True)}) f ON t.q_id = f.q_id AND t.vec_id = f.vec_id GROUP BY t.q_id",
        "get_items": "SELECT vec_id, label, len(embedding)::INT AS dim FROM embeddings WHERE vec_id % 50 = 0",
        "upsert_latest": "SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 2 ELSE 1 END AS version, round(CASE WHEN vec_id % 7 = 0 THEN -1 ELSE 1 END * list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings",
        "soft_delete": "SELECT vec_id % 10 = 3 AND vec_id % 20 <> 3 AS deleted, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM embeddings GROUP BY 1",
        "replace_deleted": """SELECT vec_id, label, vec_id % 10 = 3 AS deleted FROM embeddings WHERE vec_id NOT IN
            (SELECT vec_id FROM embeddings WHERE vec_id % 10 = 3 ORDER BY vec_id LIMIT (SELECT count(*) FROM embeddings WHERE vec_id % 25 = 0))
            UNION ALL SELECT vec_id + 1000000000, label, false FROM embeddings WHERE vec_id % 25 = 0""",
        "normalize": f'SELECT vec_id, (pos - 1)::INT AS "at", round(u[pos], 6) AS x FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS pos, {UNIT.format(a="embedding")} AS u FROM {STRETCHED})',
        "l2_bytes": """WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 127.5)::INT) AS b FROM embeddings)
            SELECT q.vec_id AS q_id, t.vec_id, list_sum(list_transform(list_zip(q.b, t.b), lambda z: (z[1]::BIGINT - z[2]) * (z[1] - z[2])))::BIGINT AS dist FROM t q, t WHERE q.vec_id % 50 = 0""",
        "pairwise_centroid_dist": f"SELECT q.cid AS i, b.cid AS j, round({dist('l2')}, 6) AS dist FROM {CENTROIDS} q, {CENTROIDS} b",
        "assign_nearest_centroid": f"SELECT vec_id, cid, round(d, 6) AS dist FROM {NEAR} WHERE rank = 1",
        "centroid_update": f'SELECT cid, (pos - 1)::INT AS "at", round(avg(embedding[pos]::DOUBLE), 6) AS x FROM (SELECT cid, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM {NEAR} WHERE rank = 1) GROUP BY cid, pos',
        "overlap_assign": OVERLAP,
        "partition_sizes": f"SELECT c.i::INT AS cid, count(o.global_id) AS n FROM range({M + 1}) c(i) LEFT JOIN ({OVERLAP}) o ON o.cid = c.i GROUP BY c.i",
        "random_partition": f"SELECT vec_id, part_id, row_number() OVER (PARTITION BY part_id ORDER BY global_id) - 1 AS local_id, global_id FROM {SPLIT}",
        "partition_offsets": f'SELECT part_id, n, coalesce(sum(n) OVER (ORDER BY part_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM (SELECT part_id, count(*) AS n FROM {SPLIT} GROUP BY part_id)',
        "order_pairwise": f"SELECT (row_number() OVER (ORDER BY a.i, b.i) - 1)::INT AS step, a.i::INT AS i, b.i::INT AS j FROM range({PARTS}) a(i), range({PARTS}) b(i) WHERE a.i < b.i",
        "order_path": f"SELECT pos AS step, i, j FROM (SELECT pos, i, lead(i) OVER (ORDER BY pos) AS j FROM {shuffled(PARTS)}) WHERE j IS NOT NULL",
        "order_circle": f"""WITH ways AS (SELECT pos AS n, i, coalesce(lead(i) OVER (ORDER BY pos), first(i) OVER (ORDER BY pos)) AS j FROM {shuffled(8)}
            UNION ALL SELECT 100 + n, i, j FROM (VALUES {_rows(CHORDS_OF_8)}) v(n, i, j)),
            once AS (SELECT * FROM ways QUALIFY row_number() OVER (PARTITION BY least(i, j), greatest(i, j) ORDER BY n) = 1)
            SELECT (row_number() OVER (ORDER BY n) - 1)::INT AS step, i::INT AS i, j::INT AS j FROM once""",
        "order_circulant": """WITH ways AS (SELECT DISTINCT least(a.i, (a.i + d.d) % 30) AS i, greatest(a.i, (a.i + d.d) % 30) AS j FROM range(30) a(i),
            (SELECT unnest(range(1, 13)) AS d UNION SELECT 15) d) SELECT (row_number() OVER (ORDER BY i, j) - 1)::INT AS step, i::INT AS i, j::INT AS j FROM ways""",
        "order_petersen": f"SELECT n::INT AS step, least(a.i, b.i) AS i, greatest(a.i, b.i) AS j FROM (VALUES {_rows(LINKS_OF_10)}) v(n, x, y) JOIN {shuffled(10)} a ON a.pos = x JOIN {shuffled(10)} b ON b.pos = y",
        "knn_graph": f"SELECT part_id, src, rank, dst, round(d, 6) AS dist FROM {GRAPH}",
        "reverse_knn": f"SELECT dst AS vec_id, count(*) AS n, min(src) AS low, max(src) AS high FROM {GRAPH} GROUP BY dst",
        "degree_stats": f"""WITH g AS {GRAPH}, d AS (SELECT e.vec_id, (SELECT count(*) FROM g WHERE src = e.vec_id) AS o, (SELECT count(*) FROM g WHERE dst = e.vec_id) AS i FROM embeddings e)
            SELECT count(*) AS nodes, sum(o)::BIGINT AS links, min(o) AS min_out, max(o) AS max_out, min(i) AS min_in, max(i) AS max_in FROM d""",
        "graph_integrity": f"""WITH g AS {GRAPH} SELECT 'unknown_node' AS rule, 0::BIGINT AS violations UNION ALL SELECT 'self_link', count(*) FROM g WHERE src = dst
            UNION ALL SELECT 'repeated_link', count(*) FROM (SELECT src, dst FROM g GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'unreached_node', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT dst FROM g)""",
        "overlap_merge": f"""WITH m AS (SELECT vec_id, cid, embedding FROM {NEAR} WHERE rank <= 2), n AS (SELECT src, dst FROM (
            SELECT q.cid, q.vec_id AS src, b.vec_id AS dst, {dist('l2')} AS d FROM m q JOIN m b ON q.cid = b.cid AND q.vec_id <> b.vec_id)
            QUALIFY row_number() OVER (PARTITION BY cid, src ORDER BY d, dst) <= 10)
            SELECT src, dst FROM (SELECT DISTINCT src, dst FROM n) QUALIFY row_number() OVER (PARTITION BY src ORDER BY md5(src::VARCHAR || '-' || dst::VARCHAR || '-42'), dst) <= 8""",
    }
