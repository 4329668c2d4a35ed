"""Approximate search: an index table with a graph for each partition, built and searched by grouped Arrow functions.

The index table has one row per vector: part_id, vec_id, level, deleted, embedding, links (ids by level). A partition
must fit a Python worker; choose the number of partitions accordingly (``parts_for``). The search of a partition
is independent of the others, and their results are ranked together.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import check_space, level_of, matrix, unit
from ..storage import written
from .graphs import Graph, padded
from .knn import RESULT, Queries, by_block, ranked

INDEX = "part_id int, vec_id long, level int, deleted boolean, embedding array<float>, links array<array<long>>"
INDEX_COLUMNS = ["part_id", "vec_id", "level", "deleted", "embedding", "links"]
#: Vectors of a partition, at most about so many.
PART_ROWS = 20_000


@dataclass(frozen=True)
class Settings:
    """Links of a node (twice as many on level 0), candidates looked at when linking, and the seed of the levels."""

    space: str = "l2"
    m: int = 16
    ef_construction: int = 200
    seed: int = 100
    hierarchical: bool = True

    def __post_init__(self):
        check_space(self.space)
        if not 2 <= self.m <= 10_000:
            raise ValueError("m must lie in 2..10000")
        object.__setattr__(self, "ef_construction", max(self.ef_construction, self.m))


def parts_for(rows: int) -> int:
    return max(1, math.ceil(rows / PART_ROWS))


def arrays(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return matrix(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)


def build(vectors: DataFrame, settings: Settings = Settings(), vector: str = "embedding") -> DataFrame:
    """The index of vectors (vec_id, embedding, part_id, optionally deleted). Ids must be unique; null ones are left out."""
    deleted = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in vectors.columns else F.lit(False)
    level = level_of(F.col("vec_id"), settings.m, settings.seed) if settings.hierarchical else F.lit(0)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull())
    rows = rows.select(F.col("part_id").cast("int").alias("part_id"), F.col("vec_id").cast("long").alias("vec_id"), level.alias("level"), deleted.alias("deleted"), F.col(vector).cast("array<float>").alias("embedding"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        ids, levels = table["vec_id"].to_numpy(), table["level"].to_numpy().astype(np.int64)
        graph = Graph.build(ids, arrays(table["embedding"]), settings.space, settings.m, settings.ef_construction, levels)
        return table.append_column("links", graph.nested_links())

    return rows.groupBy("part_id").applyInArrow(run, INDEX)


def graph_of(table: pa.Table, space: str) -> Graph:
    shown = ~table["deleted"].to_numpy(zero_copy_only=False).astype(bool)
    if "allowed" in table.column_names:
        shown &= table["allowed"].to_numpy(zero_copy_only=False).astype(bool)
    links = table["links"].combine_chunks()
    return Graph.from_columns(table["vec_id"].to_numpy(), arrays(table["embedding"]), table["level"].to_numpy(), links, space, None if shown.all() else shown)


FOUND = "q_id long, vec_id long, dist double"


def found_rows(graph: Graph, q_ids: np.ndarray, places: np.ndarray, dist: np.ndarray) -> pa.Table:
    q, at = np.nonzero(places != -1)
    return pa.table({"q_id": q_ids[q], "vec_id": graph.ids[places[q, at]], "dist": dist[q, at]})


def _probe(block: Queries, k: int, ef: int, space: str) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        graph = graph_of(table, space)
        places, dist = graph.search(block.rows, max(ef, k))
        return found_rows(graph, block.ids, places[:, :k], dist[:, :k])

    return run


def _marked(index: DataFrame, allowed: Column | None) -> DataFrame:
    return index.withColumn("allowed", F.coalesce(allowed, F.lit(False)) if allowed is not None else F.lit(True))


def search(index: DataFrame, queries: DataFrame, k: int, ef: int = 50, space: str = "l2", allowed: Column | None = None, q_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(q_id, rank, vec_id, dist): about the k nearest. ``allowed`` is a condition on the index table; vectors that fail
    it, and deleted ones, are walked through but not returned. Each partition is searched by itself, links across are not followed."""
    check_space(space)
    rows = _marked(index, allowed)

    def of(block: Queries) -> DataFrame:
        return rows.groupBy("part_id").applyInArrow(_probe(block, k, ef, space), FOUND)

    return ranked(by_block(queries, space, q_id, vector, of, FOUND), k)


def search_linked(index: DataFrame, queries: DataFrame, k: int, ef: int = 50, space: str = "l2", probes: int = 2, rounds: int = 16, allowed: Column | None = None, q_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(q_id, rank, vec_id, dist): about the k nearest in a merged index whose links cross partitions.

    A query enters ``probes`` partitions; from the best ``ef`` nodes found so far it follows the links that leave their partitions to
    nodes it has not come to, each once, until there are none or ``rounds`` are over. So no task holds more than a partition.
    Rounds are written to the shared folder.
    """
    check_space(space)
    rows, spark = _marked(index, allowed), index.sparkSession
    asked = queries.where(F.col(q_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(q_id).cast("long").alias("q_id"), F.col(vector).cast("array<float>").alias("q"))
    parts = [r[0] for r in index.select("part_id").distinct().orderBy("part_id").collect()]
    if not parts:
        return spark.createDataFrame([], RESULT)
    first = F.pmod(F.xxhash64("q_id"), F.lit(len(parts)))
    chosen = F.explode(F.transform(F.sequence(F.lit(0), F.lit(min(probes, len(parts)) - 1)), lambda i: F.try_element_at(F.array(*(F.lit(p) for p in parts)), ((first + i) % len(parts) + 1).cast("int"))))
    going = asked.withColumn("part", chosen).withColumn("starts", F.expr("cast(array() as array<bigint>)"))
    places = index.select(F.col("vec_id").alias("target"), F.col("part_id").alias("part"))
    pool = been = None

    def run(table: pa.Table, going: pa.Table) -> pa.Table:
        if not table.num_rows or not going.num_rows:
            return pa.table({"q_id": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "vec_id": pa.array([], pa.int64()), "dist": pa.array([], pa.float64()), "targets": pa.array([], pa.list_(pa.int64()))})
        graph, ids = graph_of(table, space), going["q_id"].to_numpy()
        vectors = unit_rows(arrays(going["q"]), space)
        given = going["starts"].combine_chunks()
        sizes = np.diff(given.offsets.to_numpy())
        starts = padded(np.repeat(np.arange(len(ids)), sizes), np.searchsorted(graph.ids, given.flatten().to_numpy()), len(ids))
        alone = np.flatnonzero(sizes == 0)
        starts[alone, 0] = graph.descend(vectors[alone])
        near, dist = graph.search(vectors, max(ef, k), starts)
        q, at = np.nonzero(near != -1)
        src, to = graph.outside
        by_node = padded(src, to, len(graph.ids))
        out = by_node[near[q, at]]
        there = out != -1
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(there.sum(1))], pa.int32()), pa.array(out[there], pa.int64()))
        return pa.table({"q_id": ids[q], "part": pa.array([table["part_id"][0].as_py()] * len(q), pa.int32()), "vec_id": graph.ids[near[q, at]], "dist": dist[q, at], "targets": lists})

    for _ in range(rounds):
        seen = rows.groupBy("part_id").cogroup(going.groupBy("part")).applyInArrow(run, "q_id long, part int, vec_id long, dist double, targets array<long>")
        place = F.row_number().over(Window.partitionBy("q_id").orderBy("dist", "vec_id"))
        seen = seen if pool is None else pool.unionByName(seen)
        pool = written(seen.dropDuplicates(["q_id", "vec_id"]).withColumn("place", place).where(F.col("place") <= max(ef, k)).drop("place"), "pool")
        ways = pool.select("q_id", F.explode("targets").alias("target")).distinct().join(pool.select("q_id", F.col("vec_id").alias("target")), ["q_id", "target"], "left_anti")
        ways = written((ways if been is None else ways.join(been, ["q_id", "target"], "left_anti")).join(places, "target"), "ways")
        if not ways.take(1):
            break
        been = ways.select("q_id", "target") if been is None else been.unionByName(ways.select("q_id", "target"))
        going = ways.groupBy("q_id", "part").agg(F.sort_array(F.collect_list("target")).alias("starts")).join(asked, "q_id").select("q_id", "q", "part", "starts")
    return ranked(pool.select("q_id", "vec_id", "dist"), k)


def search_cost(index: DataFrame, queries: DataFrame, k: int, ef: int = 50, space: str = "l2", q_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(q_id, hops, distances): nodes explored and distances computed by ``search``, over all partitions."""
    check_space(space)

    def of(block: Queries) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            graph = graph_of(table, space)
            graph.search(block.rows, max(ef, k))
            return pa.table({"q_id": block.ids, "hops": graph.hops, "distances": graph.computed})

        return index.groupBy("part_id").applyInArrow(run, "q_id long, hops long, distances long")

    return by_block(queries, space, q_id, vector, of, "q_id long, hops long, distances long").groupBy("q_id").agg(F.sum("hops").alias("hops"), F.sum("distances").alias("distances"))


def search_radius(index: DataFrame, queries: DataFrame, epsilon: float, min_num: int = 16, max_num: int | None = None, space: str = "l2", q_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(q_id, rank, vec_id, dist): vectors within ``epsilon``, closest first, by beams over the graphs: each begins with ``min_num``
    nodes and widens until it reaches beyond the radius (or holds ``max_num``). ``knn.radius`` is exact."""
    check_space(space)

    def of(block: Queries) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            graph = graph_of(table, space)
            full = max_num or len(graph.ids)
            found = graph.widened(block.rows, min(min_num, max(1, full)), lambda places, dist: (dist[:, -1] > epsilon) | (dist.shape[1] >= full))
            rows = [(np.full(inside.sum(), q), graph.ids[places[inside]], dist[inside]) for q, (places, dist) in zip(block.ids, found, strict=True) for inside in [dist <= epsilon]]
            q, v, d = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            return pa.table({"q_id": q.astype(np.int64), "vec_id": v, "dist": d})

        return _marked(index, None).groupBy("part_id").applyInArrow(run, FOUND)

    found = by_block(queries, space, q_id, vector, of, FOUND).withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy("dist", "vec_id")))
    return (found if max_num is None else found.where(F.col("rank") <= max_num)).select("q_id", "rank", "vec_id", "dist")


def search_documents(index: DataFrame, documents: DataFrame, queries: DataFrame, num_docs: int, ef_collection: int = 50, space: str = "l2", q_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(q_id, rank, vec_id, doc_id, dist): the longest closest-first run that touches at most ``num_docs`` documents, of what beams
    over the graphs find: each widens until it holds ``ef_collection`` documents. ``documents`` has vec_id and doc_id;
    ``knn.document_search`` is exact."""
    check_space(space)
    rows = _marked(index, None).join(documents.select("vec_id", F.col("doc_id").cast("long").alias("doc_id")), "vec_id")

    def of(block: Queries) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            graph = graph_of(table, space)
            order = np.argsort(table["vec_id"].to_numpy(), kind="stable")
            docs = table["doc_id"].to_numpy()[order]
            wanted = min(max(ef_collection, num_docs + 1), len(np.unique(docs)))
            some = lambda places: np.array([len(np.unique(docs[p[p != -1]])) >= wanted for p in places], bool)
            found = graph.widened(block.rows, max(ef_collection, 1), lambda places, dist: some(places))
            kept = [(np.full(len(p), q), graph.ids[p], docs[p], d) for q, (p, d) in zip(block.ids, found, strict=True)]
            q, v, o, d = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
            return pa.table({"q_id": q.astype(np.int64), "vec_id": v, "doc_id": o, "dist": d})

        return rows.groupBy("part_id").applyInArrow(run, "q_id long, vec_id long, doc_id long, dist double")

    found = by_block(queries, space, q_id, vector, of, "q_id long, vec_id long, doc_id long, dist double")
    closest = Window.partitionBy("q_id").orderBy("dist", "vec_id")
    new = F.row_number().over(Window.partitionBy("q_id", "doc_id").orderBy("dist", "vec_id")) == 1
    counted = found.withColumn("new", new.cast("int")).withColumn("docs", F.sum("new").over(closest)).withColumn("rank", F.row_number().over(closest))
    return counted.where(F.col("docs") <= num_docs).select("q_id", "rank", "vec_id", "doc_id", "dist")


def add(index: DataFrame, vectors: DataFrame, settings: Settings = Settings(), vector: str = "embedding") -> DataFrame:
    """The index with the vectors (vec_id, embedding) added. New ids are dealt over the partitions by a hash and linked to what a search
    finds; those that are there get the new vector, their neighbours repair their links, and they are linked anew; deletion
    marks are undone. Partitions that get nothing keep their rows. Ids of ``vectors`` must be unique."""
    spark = index.sparkSession
    parts = [r[0] for r in index.select("part_id").distinct().orderBy("part_id").collect()] or [0]
    numbers = F.array(*(F.lit(p) for p in parts))
    level = level_of(F.col("vec_id"), settings.m, settings.seed) if settings.hierarchical else F.lit(0)
    new = vectors.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<float>").alias("v"))
    new = new.join(index.select("vec_id", F.col("part_id").alias("at")), "vec_id", "left")
    part = F.coalesce("at", F.try_element_at(numbers, (F.pmod(F.xxhash64("vec_id", F.lit(settings.seed)), F.lit(len(parts))) + 1).cast("int")))
    new = new.select("vec_id", "v", part.cast("int").alias("part"), F.col("at").isNotNull().alias("there"), level.alias("level"))

    def run(key: tuple, own: pa.Table, new: pa.Table) -> pa.Table:
        if not new.num_rows:
            return own.select(INDEX_COLUMNS)
        ids, fresh = new["vec_id"].to_numpy(), ~new["there"].to_numpy(zero_copy_only=False).astype(bool)
        rows, levels = arrays(new["v"]), new["level"].to_numpy().astype(np.int64)
        if own.num_rows:
            graph = graph_of(own, settings.space)
            deleted = own["deleted"].to_numpy(zero_copy_only=False).astype(bool)[np.argsort(own["vec_id"].to_numpy(), kind="stable")]
            plain = arrays(own["embedding"])[np.argsort(own["vec_id"].to_numpy(), kind="stable")]
            graph.shown = None
        else:
            graph, deleted, plain = Graph(np.zeros(0, np.int64), np.zeros((0, rows.shape[1])), settings.space), np.zeros(0, bool), np.zeros((0, rows.shape[1]))
        vectors_of, gone = dict(zip(graph.ids.tolist(), plain, strict=True)), dict(zip(graph.ids.tolist(), deleted.tolist(), strict=True))
        vectors_of.update(zip(ids.tolist(), rows, strict=True))
        gone.update(dict.fromkeys(ids.tolist(), False))
        if (~fresh).any():
            order = np.argsort(ids[~fresh], kind="stable")
            graph = graph.updated(np.searchsorted(graph.ids, ids[~fresh][order]), rows[~fresh][order], settings.m, settings.ef_construction)
        if fresh.any():
            graph = graph.inserted(ids[fresh], rows[fresh], levels[fresh], settings.m, settings.ef_construction)
        found = graph.ids.tolist()
        embedding = pa.array([vectors_of[i].astype(np.float32) for i in found], pa.list_(pa.float32()))
        return pa.table({"part_id": pa.array(np.full(len(found), key[0].as_py()), pa.int32()), "vec_id": graph.ids, "level": pa.array(graph.levels.astype(np.int32)), "deleted": pa.array([gone[i] for i in found]), "embedding": embedding, "links": graph.nested_links()})

    return index.select(INDEX_COLUMNS).groupBy("part_id").cogroup(new.groupBy("part")).applyInArrow(run, INDEX) if vectors.take(1) else spark.createDataFrame([], INDEX).unionByName(index.select(INDEX_COLUMNS))


def edges(index: DataFrame, level: int | None = 0) -> DataFrame:
    """(part_id, level, src, dst) of the index's links, of one level or of all."""
    rows = index.select("part_id", F.col("vec_id").alias("src"), F.posexplode("links").alias("level", "to"))
    rows = rows if level is None else rows.where(F.col("level") == level)
    return rows.select("part_id", "level", "src", F.explode("to").alias("dst"))


def blocks(index: DataFrame, self_ef: int = 3, space: str = "l2", by_degree: bool = False) -> DataFrame:
    """(part_id, bid, member): the greedy cover of each partition, or the simpler one by degree; a centre is a member of its own block."""

    def run(table: pa.Table) -> pa.Table:
        graph = graph_of(table, space)
        found = [(int(graph.ids[c]), int(graph.ids[x])) for c, members in (graph.blocks_by_degree if by_degree else graph.blocks)(self_ef).items() for x in [c, *members]]
        part = table["part_id"][0].as_py()
        return pa.table({"part_id": pa.array([part] * len(found), pa.int32()), "bid": pa.array([b for b, _ in found], pa.int64()), "member": pa.array([x for _, x in found], pa.int64())})

    return index.groupBy("part_id").applyInArrow(run, "part_id int, bid long, member long")


def unit_rows(rows: np.ndarray, space: str) -> np.ndarray:
    return unit(rows) if space == "cosine" else rows
