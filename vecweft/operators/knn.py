"""Exact nearest neighbours, radius search and document search of a set of queries against all vectors.

Queries go to the workers in blocks of bounded size; each task scans its vectors once by matrix products and passes on
only what a query may still need, so what is shuffled is proportional to queries and k, not to the vectors. Filters
and deletions are plain DataFrame operations on the base table before the search, and reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import check_space, distances, matrix, one_by_one, unit
from ..storage import new_path

#: Bytes of query vectors that are sent to the workers at once.
BLOCK_BYTES = 32 << 20
#: Vectors, and queries, of a matrix product; neighbours of each of those queries whose vectors are gathered together.
ROWS, AT_ONCE, GATHER = 4096, 512, 16
#: Kept beyond k while scanning, as the products round.
SPARE = 8

RESULT = "q_id long, rank int, vec_id long, dist double"
FOUND = "q_id long, vec_id long, dist double"


class Queries:
    """A block of query vectors."""

    def __init__(self, ids: list[int], rows: list[list[float]], space: str):
        self.ids = np.array(ids, np.int64)
        self.rows = np.array(rows, np.float64).reshape(len(ids), -1)
        if space == "cosine":
            self.rows = unit(self.rows)

    def parts(self) -> Iterator[slice]:
        """Queries of a matrix product."""
        for at in range(0, len(self.ids), AT_ONCE):
            yield slice(at, min(at + AT_ONCE, len(self.ids)))


def by_block(queries: DataFrame, space: str, q_id: str, vector: str, work: Callable[[Queries], DataFrame], schema: str) -> DataFrame:
    """``work(block)`` of the queries in blocks of at most BLOCK_BYTES, as one table.

    A single block is a lazy plan. Of several one at a time is brought to the driver, searched, and its result written to the
    shared folder, so neither driver nor plan ever holds more than a block.
    """
    queries = queries.where(F.col(q_id).isNotNull() & F.col(vector).isNotNull())
    spark = queries.sparkSession
    shape = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("d")).first()
    blocks = max(1, -(-shape["n"] * 8 * max(shape["d"] or 1, 1) // BLOCK_BYTES))
    paths = []
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64(q_id), F.lit(blocks)) == block) if blocks > 1 else queries
        rows = part.select(q_id, vector).orderBy(q_id).collect()
        if not rows:
            continue
        found = work(Queries([r[0] for r in rows], [r[1] for r in rows], space))
        if blocks == 1:
            return found
        paths.append(new_path(spark, "found"))
        found.write.parquet(paths[-1])
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def scan(base: DataFrame, queries: Queries, space: str, work: Callable, schema: str, columns: tuple[str, ...] = (), vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``work(ids, rows, extra columns)`` for each block of rows of a task; it gets None at the end of the task
    and returns batches of ``schema`` or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = work()
        next(state)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = matrix(part.column(1))
                if rows.shape[1] != queries.rows.shape[1]:
                    raise ValueError(f"vectors have {rows.shape[1]} components, queries {queries.rows.shape[1]}")
                rows = unit(rows) if space == "cosine" else rows
                yield from state.send((part.column(0).to_numpy(zero_copy_only=False), rows, [part.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(columns))])) or ()
        yield from state.send(None) or ()

    return base.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"), *columns).where("vec_id is not null and v is not null").mapInArrow(run, schema)


def _batch(queries: Queries, at: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(queries.ids[at]), pa.array(ids), pa.array(dist)], ["q_id", "vec_id", "dist"])


def _nearest(queries: Queries, k: int, space: str, exclude_self: bool) -> Callable:
    """Running k nearest of each query over the rows of a task: ids and exact distances, no vectors."""

    def closest(part: slice, new_ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact distances of the rows that may be among the k nearest of each query."""
        asked, keep = queries.rows[part], k + SPARE
        dist = distances(asked, rows, space)
        if exclude_self:
            dist = np.where(new_ids[None, :] == queries.ids[part, None], np.inf, dist)
        if dist.shape[1] > keep:
            near = np.argpartition(dist, keep - 1, axis=1)[:, :keep]
            edge = np.take_along_axis(dist, near, 1).max(1)
            # Rows as near as the last one kept: the smaller ids stay.
            tied = np.flatnonzero((dist <= edge[:, None]).sum(1) > keep)
            if len(tied):
                near[tied] = np.lexsort((np.broadcast_to(new_ids, (len(tied), len(new_ids))), dist[tied]), axis=1)[:, :keep]
        else:
            near = np.broadcast_to(np.arange(dist.shape[1]), dist.shape)
        exact = np.empty(near.shape)
        for at in range(0, near.shape[1], GATHER):
            exact[:, at : at + GATHER] = one_by_one(asked[:, None, :], rows[near[:, at : at + GATHER]], space)
        return new_ids[near], np.where(np.isinf(np.take_along_axis(dist, near, 1)), np.inf, exact)

    def work():
        best = [np.zeros((p.stop - p.start, 0)) for p in queries.parts()]
        ids = [np.zeros((p.stop - p.start, 0), np.int64) for p in queries.parts()]
        got = yield
        while got is not None:
            new_ids, rows, _ = got
            for i, part in enumerate(queries.parts()):
                near, exact = closest(part, new_ids, rows)
                all_best, all_ids = np.concatenate((best[i], exact), 1), np.concatenate((ids[i], near), 1)
                order = np.lexsort((all_ids, all_best), axis=1)[:, :k]
                best[i], ids[i] = np.take_along_axis(all_best, order, 1), np.take_along_axis(all_ids, order, 1)
            got = yield None
        out = []
        for i, part in enumerate(queries.parts()):
            q, at = np.nonzero(~np.isinf(best[i]))
            out.append(_batch(queries, q + part.start, ids[i][q, at], best[i][q, at]))
        yield out

    return work


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k closest rows of each query, closest first, the smaller id of equals."""
    place = F.row_number().over(Window.partitionBy("q_id").orderBy("dist", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("q_id", "rank", "vec_id", "dist")


def knn(queries: DataFrame, base: DataFrame, k: int, space: str = "l2", exclude_self: bool = False, strict: bool = False, q_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(q_id, rank, vec_id, dist): the k vectors of ``base`` closest to each query, ties by id.

    Queries and base have an id column and an array column of one length; null ids and vectors are skipped. With
    ``strict`` a query that finds fewer than k raises an error. ``exclude_self`` skips the vector of the query's id.
    Apply filters to ``base``: ``knn(queries, base.where(...), k)``.
    """
    check_space(space)
    if k < 1:
        raise ValueError("k must be at least 1")
    found = by_block(queries, space, q_id, vector, lambda block: scan(base, block, space, _nearest(block, k, space, exclude_self), FOUND, vector=vector), FOUND)
    found = ranked(found, k)
    if strict:
        counts = queries.select(F.col(q_id).alias("q_id")).distinct().join(found.groupBy("q_id").agg(F.count(F.lit(1)).alias("n")), "q_id", "left")
        short = counts.where(F.coalesce("n", F.lit(0)) < k).first()
        if short is not None:
            raise ValueError(f"query {short['q_id']} has {short['n'] or 0} neighbours, fewer than k = {k}")
    return found


def self_search(base: DataFrame, k: int, space: str = "l2") -> DataFrame:
    """Each vector's k nearest, itself included."""
    return knn(base, base, k, space)


def radius(queries: DataFrame, base: DataFrame, epsilon: float, space: str = "l2", max_num: int | None = None, q_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(q_id, rank, vec_id, dist): vectors within ``epsilon`` of each query, closest first, the first ``max_num`` if given.

    For ``l2`` the radius is of squared distance. Products only preselect; distances are compared exactly.
    """
    check_space(space)

    def within(queries: Queries) -> Callable:
        def work():
            got, out = (yield), None
            while got is not None:
                ids, rows, _ = got
                out = []
                for part in queries.parts():
                    at, near = np.nonzero(distances(queries.rows[part], rows, space) <= epsilon + 1e-9 * (1 + abs(epsilon)))
                    at += part.start
                    exact = np.empty(len(at))
                    for i in range(0, len(at), AT_ONCE * GATHER):
                        some = slice(i, i + AT_ONCE * GATHER)
                        exact[some] = one_by_one(queries.rows[at[some]], rows[near[some]], space)
                    inside = exact <= epsilon
                    at, near, exact = at[inside], near[inside], exact[inside]
                    if max_num is not None:
                        order = np.lexsort((ids[near], exact, at))
                        at, near, exact = at[order], near[order], exact[order]
                        first = np.arange(len(at)) - np.searchsorted(at, at) < max_num
                        at, near, exact = at[first], near[first], exact[first]
                    out.append(_batch(queries, at, ids[near], exact))
                got = yield out
            yield None

        return work

    found = by_block(queries, space, q_id, vector, lambda block: scan(base, block, space, within(block), FOUND, vector=vector), FOUND)
    place = F.row_number().over(Window.partitionBy("q_id").orderBy("dist", "vec_id"))
    found = found.withColumn("rank", place)
    return (found if max_num is None else found.where(F.col("rank") <= max_num)).select("q_id", "rank", "vec_id", "dist")


def document_search(queries: DataFrame, base: DataFrame, num_docs: int, space: str = "l2", doc_id: str = "doc_id", q_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(q_id, rank, vec_id, doc_id, dist): the longest closest-first run of vectors that touches at most ``num_docs`` documents.

    First the least (distance, id) of each document and query is found; the one of document number ``num_docs`` + 1 is
    the cutoff, and a second scan returns what lies before it.
    """
    check_space(space)
    named = base.withColumn("__doc", F.col(doc_id).cast("long"))

    def exact(block: Queries, part: slice, rows: np.ndarray) -> np.ndarray:
        return np.stack([one_by_one(q[None, :], rows, space) for q in block.rows[part]])

    def search(block: Queries) -> DataFrame:
        def least() -> Iterator:
            got = yield
            while got is not None:
                ids, rows, (docs,) = got
                order = np.lexsort((ids, docs))
                starts = np.flatnonzero(np.r_[True, docs[order][1:] != docs[order][:-1]])
                owner = np.searchsorted(starts, np.arange(len(order)), "right") - 1
                out = []
                for part in block.parts():
                    dist = exact(block, part, rows)[:, order]
                    low = np.minimum.reduceat(dist, starts, axis=1)
                    first = np.minimum.reduceat(np.where(dist == low[:, owner], ids[order][None, :], np.iinfo(np.int64).max), starts, axis=1)
                    m, n = low.shape
                    out.append(pa.RecordBatch.from_arrays([pa.array(np.repeat(block.ids[part], n)), pa.array(np.tile(docs[order][starts].astype(np.int64), m)), pa.array(low.ravel()), pa.array(first.ravel())], ["q_id", "doc_id", "dist", "vec_id"]))
                got = yield out
            yield None

        firsts = scan(named, block, space, least, "q_id long, doc_id long, dist double, vec_id long", ("__doc",), vector=vector)
        firsts = firsts.groupBy("q_id", "doc_id").agg(F.min(F.struct("dist", "vec_id")).alias("f"))
        place = F.row_number().over(Window.partitionBy("q_id").orderBy("f"))
        cutoffs = {r["q_id"]: (r["f"]["dist"], r["f"]["vec_id"]) for r in firsts.withColumn("at", place).where(F.col("at") == num_docs + 1).select("q_id", "f").collect()}
        cut = np.array([cutoffs.get(int(q), (np.inf, 0))[0] for q in block.ids])
        cut_id = np.array([cutoffs.get(int(q), (np.inf, np.iinfo(np.int64).max))[1] for q in block.ids])

        def before() -> Iterator:
            got = yield
            while got is not None:
                ids, rows, (docs,) = got
                out = []
                for part in block.parts():
                    dist = exact(block, part, rows)
                    at, near = np.nonzero((dist < cut[part, None]) | ((dist == cut[part, None]) & (ids[None, :] < cut_id[part, None])))
                    out.append(pa.RecordBatch.from_arrays([pa.array(block.ids[part][at]), pa.array(ids[near]), pa.array(docs[near].astype(np.int64)), pa.array(dist[at, near])], ["q_id", "vec_id", "doc_id", "dist"]))
                got = yield out
            yield None

        return scan(named, block, space, before, "q_id long, vec_id long, doc_id long, dist double", ("__doc",), vector=vector)

    found = by_block(queries, space, q_id, vector, search, "q_id long, vec_id long, doc_id long, dist double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy("dist", "vec_id"))).select("q_id", "rank", "vec_id", "doc_id", "dist")
