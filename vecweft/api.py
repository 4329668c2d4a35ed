"""``Index`` and ``FlatIndex``: a vector index with the calls of an in-process library, over Spark tables.

Both hold an immutable table (vec_id, embedding, deleted) that each change replaces, written in the session's shared folder;
``Index`` builds a graph for each partition when it is first searched, and adds later insertions to it. Calls take and return NumPy arrays or DataFrames: arrays are for
interactive sizes, ``knn`` over DataFrames is for large ones. ``num_threads`` is accepted and has no effect.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.vector import check_space
from .operators import index as ann
from .operators import knn, metrics, partition, tables
from .storage import written

VECTORS = "vec_id long, embedding array<float>, deleted boolean"
#: Version of saved state.
VERSION = 2
#: A graph to which so many times its vectors have been added is built anew, in more partitions.
MOST_GROWTH = 2


def as_matrix(data) -> np.ndarray:
    """float32 rows; one dimension is one row, more than two are an error."""
    rows = np.asarray(data, np.float32)
    rows = rows[None, :] if rows.ndim == 1 else rows
    if rows.ndim != 2:
        raise ValueError("data must have one or two dimensions")
    return rows


def as_ids(ids, rows: int, first: int) -> list[int]:
    if ids is None:
        return list(range(first, first + rows))
    found = np.asarray(ids)
    if found.ndim == 0:
        if rows != 1:
            raise ValueError("one id for several rows")
        found = found[None]
    if found.ndim != 1 or len(found) != rows:
        raise ValueError(f"{rows} ids are needed, in one dimension")
    return [int(i) for i in found]


def condition(filter: Callable[[int], bool] | Column | Iterable[int] | None, id_col: str = "vec_id") -> Column | None:
    """A filter as a Column: itself, membership in a set of ids, or a Python predicate of the id, called for each id of an Arrow
    batch (the slow way: prefer a Column)."""
    if filter is None or isinstance(filter, Column):
        return filter
    if callable(filter):

        @F.arrow_udf("boolean")
        def allowed(ids: pa.Array) -> pa.Array:
            return pa.array([i is not None and bool(filter(i)) for i in ids.to_pylist()], pa.bool_())

        return allowed(F.col(id_col))
    return F.col(id_col).isin([int(i) for i in filter])


class _Table:
    """What both kinds share."""

    def __init__(self, space: str, dim: int, spark: SparkSession | None = None):
        self.space, self.dim = check_space(space), int(dim)
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.num_threads = 1
        self.max_elements = 0
        self.vectors: DataFrame | None = None
        self._next = 0

    def _ready(self) -> DataFrame:
        if self.vectors is None:
            raise RuntimeError("init_index or load_index comes first")
        return self.vectors

    def _init(self, max_elements: int) -> None:
        if self.vectors is not None:
            raise RuntimeError("the index is initialised already")
        self.max_elements = int(max_elements)
        self._set(self.spark.createDataFrame([], VECTORS))

    def _set(self, table: DataFrame) -> None:
        # Each change is evaluated once and written, which cuts its lineage and survives a lost executor.
        self.vectors = written(table.select("vec_id", "embedding", "deleted"), "vectors")

    def _frame(self, data, ids) -> tuple[DataFrame, int]:
        if isinstance(data, DataFrame):
            wrong = data.where(F.size("embedding") != self.dim).first()
            if wrong is not None:
                raise ValueError(f"vectors must have {self.dim} components")
            return data.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")), data.count()
        rows = as_matrix(data)
        if rows.shape[1] != self.dim:
            raise ValueError(f"vectors must have {self.dim} components, not {rows.shape[1]}")
        return self.spark.createDataFrame(list(zip(as_ids(ids, len(rows), self._next), rows.tolist(), strict=True)), "vec_id long, embedding array<float>"), len(rows)

    def _queries(self, data) -> tuple[DataFrame, int]:
        if isinstance(data, DataFrame):
            return data.select("vec_id", "embedding"), -1
        rows = as_matrix(data)
        if rows.shape[1] != self.dim:
            raise ValueError(f"queries must have {self.dim} components, not {rows.shape[1]}")
        return self.spark.createDataFrame(list(enumerate(rows.tolist())), "vec_id long, embedding array<float>"), len(rows)

    @staticmethod
    def _arrays(found: DataFrame, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        got = found.orderBy("q_id", "rank").collect()
        if len(got) != rows * k:
            raise RuntimeError(f"fewer than k = {k} neighbours found; a larger ef or a smaller k may help")
        return np.array([r["vec_id"] for r in got], np.uint64).reshape(rows, k), np.array([r["dist"] for r in got], np.float32).reshape(rows, k)

    def set_num_threads(self, num_threads: int) -> None:
        self.num_threads = int(num_threads)

    def get_max_elements(self) -> int:
        return self.max_elements

    def get_current_count(self) -> int:
        return self._ready().count()

    def _checked(self, table: DataFrame) -> None:
        n = table.count()
        if n > self.max_elements:
            raise RuntimeError(f"{n} elements exceed the maximum of {self.max_elements}")
        self._set(table)

    def _ids(self, ids) -> DataFrame:
        return self.spark.createDataFrame([(int(i),) for i in np.atleast_1d(np.asarray(ids)).tolist()], "vec_id long")

    def _save(self, path: str, state: dict) -> None:
        # Tables of one save lie in a folder of their own, and the state names it: a save to the path that was loaded never
        # overwrites what is being read, and one that fails leaves the last.
        folder = f"{path}/{uuid.uuid4().hex}"
        self._ready().write.parquet(f"{folder}/vectors")
        if "graph" in state:
            state.pop("graph").write.parquet(f"{folder}/graph")
        state = {"version": VERSION, "space": self.space, "dim": self.dim, "max_elements": self.max_elements, "next": self._next, "folder": folder.rpartition("/")[2], "at": time.time()} | state
        self.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("append").text(f"{path}/state")

    def _state_at(self, path: str) -> dict:
        """The last state that was saved: there are as many as saves to the path."""
        return max((json.loads(r[0]) for r in self.spark.read.text(f"{path}/state").collect()), key=lambda s: s["at"])

    def _load(self, path: str, max_elements: int) -> dict:
        state = self._state_at(path)
        if state["version"] != VERSION or state["space"] != self.space or state["dim"] != self.dim:
            raise ValueError(f"{path} holds version {state['version']}, space {state['space']}, dimension {state['dim']}")
        table = self.spark.read.schema(VECTORS).parquet(f"{path}/{state['folder']}/vectors")
        self.max_elements, self._next = max(max_elements, state["max_elements"]), state["next"]
        if max_elements and table.count() > max_elements:
            raise RuntimeError("max_elements is below the number of elements")
        self._set(table)
        return state

    def index_file_size(self, path: str) -> int:
        """Bytes of the files of a saved index."""
        folder = f"{path}/{self._state_at(path)['folder']}"
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([folder, f"{path}/state"]).agg(F.sum("length")).first()[0]


class FlatIndex(_Table):
    """Exact search."""

    def init_index(self, max_elements: int) -> None:
        self._init(max_elements)

    def add_items(self, data, ids=None) -> None:
        new, n = self._frame(data, ids)
        self._next += n
        table = tables.upsert(self._ready().withColumn("version", F.lit(0)), new.dropDuplicates(["vec_id"]).withColumns({"deleted": F.lit(False), "version": F.lit(1)}))
        self._checked(table)

    def delete_vector(self, id: int) -> None:
        self._set(tables.delete(self._ready(), self._ids(id)))

    def knn_query(self, data, k: int = 1, num_threads: int = -1, filter=None):
        """(labels, distances), closest first; for a DataFrame of queries (vec_id, embedding) the rows of the result."""
        queries, rows = self._queries(data)
        base = self._ready()
        base = base if filter is None else base.where(condition(filter))
        found = knn.knn(queries, base, k, self.space)
        return found if rows < 0 else self._arrays(found, rows, k)

    def save_index(self, path: str) -> None:
        self._save(path, {})

    def load_index(self, path: str, max_elements: int = 0) -> None:
        self._load(path, max_elements)

    def __repr__(self) -> str:
        return f"<vecweft.FlatIndex(space='{self.space}', dim={self.dim})>"


class Index(_Table):
    """Approximate search by partition graphs."""

    def __init__(self, space: str | None = None, dim: int | None = None, params: dict | None = None, index: Index | None = None, spark: SparkSession | None = None):
        source = index.get_params() if index is not None else params
        super().__init__(source["space"] if source else space, source["dim"] if source else dim, spark)
        self.settings, self._ef, self.allow_replace_deleted, self._graph, self.parts = ann.Settings(self.space), 10, False, None, None
        if source:
            self._restore(source)

    def init_index(self, max_elements: int, M: int = 16, ef_construction: int = 200, random_seed: int = 100, allow_replace_deleted: bool = False) -> None:
        self._init(max_elements)
        self.settings = ann.Settings(self.space, M, ef_construction, random_seed)
        self.allow_replace_deleted = allow_replace_deleted

    def _set(self, table: DataFrame) -> None:
        super()._set(table)
        self._graph = None

    @property
    def ef(self) -> int:
        return self._ef

    @property
    def M(self) -> int:  # noqa: N802
        return self.settings.m

    @property
    def ef_construction(self) -> int:
        return self.settings.ef_construction

    @property
    def element_count(self) -> int:
        return self.get_current_count()

    def set_ef(self, ef: int) -> None:
        self._ef = int(ef)

    def graph(self) -> DataFrame:
        """The index table: built when first searched; later insertions are added to it."""
        if self._graph is None:
            table = self._ready()
            parts = self.parts or ann.parts_for(table.count())
            placed = partition.random_partition(table, parts) if parts > 1 else table.withColumn("part_id", F.lit(0))
            self._graph = written(ann.build(placed, self.settings), "graph")
        return self._graph

    def add_items(self, data, ids=None, num_threads: int = -1, replace_deleted: bool = False) -> None:
        """Insert vectors; those whose id is there replace it and undo its deletion. With ``replace_deleted`` new ones take
        the slots of deleted ones first."""
        new, n = self._frame(data, ids)
        self._next += n
        new, table = new.dropDuplicates(["vec_id"]), self._ready()
        if replace_deleted and not self.allow_replace_deleted:
            raise RuntimeError("the index was not initialised with allow_replace_deleted")
        if replace_deleted:
            self._checked(tables.replace_deleted(table, new))
            return
        if self.allow_replace_deleted and (gone := new.join(table.where("deleted"), "vec_id", "left_semi").first()):
            raise RuntimeError(f"{gone['vec_id']} is deleted, and its slot may be taken; insert with replace_deleted")
        graph = self._graph
        self._checked(tables.upsert(table.withColumn("version", F.lit(0)), new.withColumns({"deleted": F.lit(False), "version": F.lit(1)})))
        if graph is not None and self.get_current_count() <= MOST_GROWTH * graph.count():
            self._graph = written(ann.add(graph, new, self.settings), "graph")

    def knn_query(self, data, k: int = 1, num_threads: int = -1, filter=None):
        """(labels, distances), closest first; for a DataFrame of queries (vec_id, embedding) the rows of the result."""
        queries, rows = self._queries(data)
        found = ann.search(self.graph(), queries, k, max(self._ef, k), self.space, condition(filter))
        return found if rows < 0 else self._arrays(found, rows, k)

    def get_items(self, ids, return_type: str = "numpy"):
        if return_type not in ("numpy", "list"):
            raise ValueError("return_type is numpy or list")
        if np.asarray(ids).ndim == 0:
            raise ValueError("ids must be a sequence")
        wanted = [int(i) for i in ids]
        found = {r["vec_id"]: r["embedding"] for r in tables.get_items(self._ready(), self._ids(wanted)).collect()} if wanted else {}
        rows = [found[i] for i in wanted]
        return np.array(rows, np.float32) if return_type == "numpy" else rows

    def get_ids_list(self) -> list[int]:
        """All ids, deleted ones included."""
        return [r[0] for r in self._ready().select("vec_id").orderBy("vec_id").collect()]

    def _mark(self, change: Callable[[DataFrame, DataFrame], DataFrame], id: int) -> None:
        graph, ids = self._graph, self._ids(id)
        self._set(change(self._ready(), ids))
        if graph is not None:
            self._graph = written(change(graph, ids), "graph")

    def mark_deleted(self, id: int) -> None:
        """Deleted vectors keep their links, and are not returned."""
        self._mark(tables.mark_deleted, id)

    def unmark_deleted(self, id: int) -> None:
        self._mark(tables.unmark_deleted, id)

    def resize_index(self, new_size: int) -> None:
        if new_size < self.get_current_count():
            raise RuntimeError("the new size is below the number of elements")
        self.max_elements = int(new_size)

    def _state(self) -> dict:
        return {"m": self.settings.m, "ef_construction": self.settings.ef_construction, "seed": self.settings.seed, "ef": self._ef, "allow_replace_deleted": self.allow_replace_deleted}

    def save_index(self, path: str) -> None:
        """Vectors, state and the graph, as tables in a folder."""
        self._save(path, self._state() | {"graph": self.graph()})

    def load_index(self, path: str, max_elements: int = 0, allow_replace_deleted: bool = False) -> None:
        state = self._load(path, max_elements)
        self.settings = ann.Settings(self.space, state["m"], state["ef_construction"], state["seed"])
        self._ef, self.allow_replace_deleted = state["ef"], allow_replace_deleted
        graph = self.spark.read.schema(ann.INDEX).parquet(f"{path}/{state['folder']}/graph")
        lost = graph.select("vec_id").exceptAll(self.vectors.select("vec_id")).first()
        if lost is not None or graph.count() != self.vectors.count():
            raise ValueError(f"{path}: the graph and the vectors differ")
        wrong = metrics.integrity(ann.edges(graph, None), self.vectors).where("violations > 0 and rule in ('unknown_node', 'self_link')").first()
        if wrong is not None:
            raise ValueError(f"{path}: {wrong['violations']} links break the rule {wrong['rule']}")
        self._graph = graph

    def get_params(self) -> dict:
        """The whole state as plain values, for pickling; for interactive sizes."""
        rows = None if self.vectors is None else [tuple(r) for r in self.vectors.orderBy("vec_id").collect()]
        return {"version": VERSION, "space": self.space, "dim": self.dim, "max_elements": self.max_elements, "next": self._next, "rows": rows} | self._state()

    def _restore(self, state: dict) -> None:
        if state.get("version") != VERSION:
            raise ValueError(f"state of version {state.get('version')}")
        self.settings = ann.Settings(self.space, state["m"], state["ef_construction"], state["seed"])
        self._ef, self.allow_replace_deleted = state["ef"], state["allow_replace_deleted"]
        if state["rows"] is not None:
            self._init(state["max_elements"])
            self._set(self.spark.createDataFrame(state["rows"], VECTORS))
            self._next = state["next"]

    def __getstate__(self) -> dict:
        return self.get_params()

    def __setstate__(self, state: dict) -> None:
        self.__init__(params=state)

    def __repr__(self) -> str:
        return f"<vecweft.Index(space='{self.space}', dim={self.dim})>"


class LazyIndex(Index):
    """An index that initialises itself at the first insertion; before that searches find nothing."""

    def __init__(self, space: str, dim: int, max_elements: int = 1024, ef_construction: int = 200, M: int = 16, spark: SparkSession | None = None):
        super().__init__(space, dim, spark=spark)
        self.initial = max_elements, M, ef_construction

    def add_items(self, data, ids=None, num_threads: int = -1, replace_deleted: bool = False) -> None:
        if self.vectors is None:
            size, m, ef_construction = self.initial
            self.init_index(size, m, ef_construction)
        super().add_items(data, ids, num_threads, replace_deleted)

    def knn_query(self, data, k: int = 1, num_threads: int = -1, filter=None):
        return ([], []) if self.vectors is None else super().knn_query(data, k, num_threads, filter)

    def get_items(self, ids, return_type: str = "numpy"):
        """Before the first insertion no id is there; none asked for is an empty answer."""
        if self.vectors is None:
            if len(ids):
                raise KeyError(f"id {ids[0]} not found")
            return np.zeros((0, self.dim), np.float32) if return_type == "numpy" else []
        return super().get_items(ids, return_type)

    def get_ids_list(self) -> list[int]:
        return [] if self.vectors is None else super().get_ids_list()

    def get_current_count(self) -> int:
        return 0 if self.vectors is None else super().get_current_count()

    def resize_index(self, new_size: int) -> None:
        """Before the first insertion it sets the size to begin with."""
        if self.vectors is None:
            self.initial = (int(new_size), *self.initial[1:])
        else:
            super().resize_index(new_size)

    def get_max_elements(self) -> int:
        return self.initial[0] if self.vectors is None else super().get_max_elements()


class ObjectIndex:
    """An index whose results are arbitrary Python objects, kept beside their ids."""

    def __init__(self, index: Index):
        self.index, self.objects = index, {}

    def add_items(self, data, objects: Iterable) -> None:
        ids = [uuid.uuid4().int >> 65 for _ in range(len(as_matrix(data)))]
        self.index.add_items(data, ids)
        self.objects.update(zip(ids, objects, strict=True))

    def knn_query(self, data, k: int = 1):
        labels, dist = self.index.knn_query(data, k)
        return [[self.objects[int(i)] for i in row] for row in labels], dist
