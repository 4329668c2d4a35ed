"""Vector files as a Spark data source, ``format("vecweft.vecfile")`` after ``register(spark)``.

Layouts (all little-endian): ``vecs`` repeats an int32 dimension and the components; ``bin`` has a header of two int32,
rows and dimension, and then all components; ``raw`` has components only, and needs the option ``dim``.
Elements: ``f4`` (float), ``i4`` (int), ``u1`` (unsigned byte). By suffix: .fvecs .ivecs .bvecs .fbin .ibin .u8bin.

Reading splits a file into byte ranges of whole records; rows are (vec_id, embedding), numbered over the sorted files of
the path. Options: ``layout``, ``element``, ``dim``, ``startIdx``, ``chunkSize`` (clamped to what is there), ``mode``
(``FAILFAST`` raises on a truncated or uneven file, ``DROPMALFORMED`` drops a truncated last record, and reads ``vecs`` records
of different dimension one after the other). Writing takes vec_id and embedding in partitions that are sorted and do not overlap
(``write_vectors`` makes such). Paths go through pyarrow's file systems, so they can be URIs of a store.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Layout and element by suffix.
SUFFIXES = {".fvecs": ("vecs", "f4"), ".ivecs": ("vecs", "i4"), ".bvecs": ("vecs", "u1"), ".fbin": ("bin", "f4"), ".ibin": ("bin", "i4"), ".u8bin": ("bin", "u1")}
SQL_TYPES = {"f4": "array<float>", "i4": "array<int>", "u1": "array<smallint>"}
ARROW_TYPES = {"f4": pa.float32(), "i4": pa.int32(), "u1": pa.int16()}
#: Bytes of a partition, about, and of a read.
SPLIT, READ = 64 << 20, 4 << 20


def kind_of(path: str, options: dict) -> tuple[str, str]:
    """Layout and element, by option or else by suffix."""
    for suffix, (layout, element) in SUFFIXES.items():
        if path.rstrip("/").endswith(suffix):
            break
    else:
        layout, element = "", ""
    layout, element = options.get("layout", layout), options.get("element", element)
    if layout not in ("vecs", "bin", "raw") or element not in SQL_TYPES:
        raise ValueError(f"{path}: unknown vector file; known suffixes are {', '.join(SUFFIXES)}, or give layout and element")
    return layout, element


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    system, plain = opened(path)
    info = system.get_file_info(plain)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(plain, info.size)]
    inside = system.get_file_info(fs.FileSelector(plain))
    return sorted((i.path, i.size) for i in inside if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")))


@dataclass
class Range(InputPartition):
    """Records of a file: where they begin, how many, and the id of the first."""

    file: str
    start: int
    records: int
    first_id: int
    dim: int

    def __init__(self, file: str, start: int, records: int, first_id: int, dim: int):
        super().__init__(None)
        self.file, self.start, self.records, self.first_id, self.dim = file, start, records, first_id, dim


class VectorReader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.path, self.options = path, options
        self.layout, self.element = kind_of(path, options)
        self.width = np.dtype(self.element).itemsize
        self.strict = options.get("mode", "FAILFAST").upper() != "DROPMALFORMED"

    def shape(self, file: str, size: int) -> tuple[int, int, int, int]:
        """(dim, bytes before the records, bytes of a record, records) of a file."""
        system, _ = opened(self.path)
        with system.open_input_file(file) as f:
            head = f.read(8)
        if self.layout == "raw":
            dim, skip = int(self.options["dim"]), 0
        elif size == 0:
            return 0, 0, 1, 0
        else:
            skip = 0 if self.layout == "vecs" else 8
            if len(head) < max(4, skip):
                raise ValueError(f"{file}: no header")
            dim = struct.unpack("<i", head[:4] if self.layout == "vecs" else head[4:8])[0]
        if dim <= 0:
            raise ValueError(f"{file}: dimension {dim}")
        record = dim * self.width + (4 if self.layout == "vecs" else 0)
        there = (size - skip) // record
        if self.layout == "bin":
            stated = struct.unpack("<I", head[:4])[0]
            if stated > there and self.strict:
                raise ValueError(f"{file}: vector {there} of {stated} is cut off")
            there = min(there, stated)
        elif (size - skip) % record and self.strict:
            raise ValueError(f"{file}: vector {there} is cut off, or dimensions differ")
        return dim, skip, record, there

    def partitions(self) -> list[Range]:
        found, first_id, mixed = [], 0, self.layout == "vecs" and not self.strict
        start_idx = int(self.options.get("startidx", self.options.get("startIdx", 0)))
        chunk = self.options.get("chunksize", self.options.get("chunkSize"))
        end = start_idx + int(chunk) if chunk is not None else None
        for file, size in files_of(self.path):
            if mixed:
                found.append(Range(file, 0, -1, first_id, 0))
                first_id += 1 << 40
                continue
            dim, skip, record, there = self.shape(file, size)
            low = max(0, start_idx - first_id)
            high = there if end is None else min(there, end - first_id)
            step = max(1, SPLIT // record)
            for at in range(low, max(low, high), step):
                found.append(Range(file, skip + at * record, min(step, high - at), first_id + at, dim))
            first_id += there
        return found or [Range("", 0, 0, 0, 1)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        system, _ = opened(self.path)
        with system.open_input_file(part.file) as f:
            if part.records < 0:
                yield from self._mixed(f, part.first_id)
                return
            kinds = [("v", self.element, (part.dim,))]
            record = np.dtype([("d", "<i4"), *kinds] if self.layout == "vecs" else kinds)
            f.seek(part.start)
            left, at, most = part.records, part.first_id, max(1, READ // record.itemsize)
            while left:
                n = min(left, most)
                rows = np.frombuffer(f.read(n * record.itemsize), record)
                if self.layout == "vecs" and (rows["d"] != part.dim).any():
                    raise ValueError(f"{part.file}: vector {at + int(np.flatnonzero(rows['d'] != part.dim)[0])} has another dimension")
                yield self._batch(np.arange(at, at + n), list(rows["v"]))
                left, at = left - n, at + n

    def _mixed(self, f, at: int) -> Iterator[pa.RecordBatch]:
        rows: list[np.ndarray] = []
        while len(head := f.read(4)) == 4:
            size = struct.unpack("<i", head)[0] * self.width
            if size < 0 or len(body := f.read(size)) < size:
                break
            rows.append(np.frombuffer(body, self.element))
            if len(rows) == 1024:
                yield self._batch(np.arange(at, at + len(rows)), rows)
                at, rows = at + len(rows), []
        if rows:
            yield self._batch(np.arange(at, at + len(rows)), rows)

    def _batch(self, ids: np.ndarray, rows: list[np.ndarray]) -> pa.RecordBatch:
        kind = ARROW_TYPES[self.element]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([r.astype(kind.to_pandas_dtype()) for r in rows], pa.list_(kind))], ["vec_id", "embedding"])


@dataclass
class Written(WriterCommitMessage):
    """A part file: its first id, how many vectors and of what dimension."""

    path: str | None
    first_id: int = 0
    records: int = 0
    dim: int = 0


class VectorWriter(DataSourceWriter):
    """Each task streams its rows, in the order of their ids, into a part file of its own; the commit lays the parts end to end, by
    their first ids, in one file. A task that is tried again or twice writes another part; only those committed count."""

    def __init__(self, path: str, options: dict, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.layout, self.element = kind_of(path, options)
        system, plain = opened(path)
        if not overwrite and system.get_file_info(plain).type != fs.FileType.NotFound:
            raise FileExistsError(path)
        self.folder = f"{plain}.parts-{uuid.uuid4().hex}"
        system.create_dir(self.folder)

    def write(self, rows: Iterator) -> Written:
        system, _ = opened(self.path)
        out, done, held = None, Written(None), []
        try:
            for row in rows:
                values = np.asarray(row["embedding"])
                if values.ndim != 1:
                    raise ValueError("vectors are one-dimensional")
                if self.element == "u1" and len(values) and (values.min() < 0 or values.max() > 255):
                    raise ValueError("bytes lie in 0..255")
                if out is None:
                    done = Written(f"{self.folder}/{uuid.uuid4().hex}", int(row["vec_id"]), 0, len(values))
                    out = system.open_output_stream(done.path)
                if len(values) != done.dim:
                    raise ValueError(f"vector {row['vec_id']} has {len(values)} components, not {done.dim}")
                held.append((struct.pack("<i", done.dim) if self.layout == "vecs" else b"") + values.astype(self.element).tobytes())
                done.records += 1
                if len(held) == 1024:
                    out.write(b"".join(held))
                    held.clear()
            if out is not None:
                out.write(b"".join(held))
        finally:
            if out is not None:
                out.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.path), key=lambda m: m.first_id)
        if len({m.dim for m in parts}) > 1:
            raise ValueError(f"vectors have {sorted({m.dim for m in parts})} components")
        system, plain = opened(self.path)
        with system.open_output_stream(f"{self.folder}/whole") as f:
            if self.layout == "bin":
                f.write(struct.pack("<ii", sum(m.records for m in parts), parts[0].dim if parts else 0))
            for part in parts:
                with system.open_input_stream(part.path) as data:
                    while block := data.read(READ):
                        f.write(block)
        system.move(f"{self.folder}/whole", plain)
        system.delete_dir(self.folder)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.path)
        if system.get_file_info(self.folder).type != fs.FileType.NotFound:
            system.delete_dir(self.folder)


class VectorFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vecweft.vecfile"

    def schema(self) -> str:
        return f"vec_id bigint, embedding {SQL_TYPES[kind_of(self.options['path'], self.options)[1]]}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return VectorReader(self.options["path"], dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return VectorWriter(self.options["path"], dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VectorFiles)


def read_vectors(spark: SparkSession, path: str, **options):
    """(vec_id, embedding) of a vector file or of a folder of files of one kind."""
    register(spark)
    return spark.read.format("vecweft.vecfile").options(**options).load(path)


def write_vectors(df, path: str, mode: str = "overwrite", **options) -> None:
    """One file of the vectors in order of vec_id, written in parts by ranges of it."""
    register(df.sparkSession)
    ordered = df.select("vec_id", "embedding").repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    ordered.write.format("vecweft.vecfile").options(**options).mode(mode).save(path)


def write_truth(found, ids_path: str, dist_path: str) -> None:
    """Results (q_id, rank, vec_id, dist) as a file of neighbour ids and one of distances, a row for each query in order of q_id."""
    lists = F.sort_array(F.collect_list(F.struct("rank", "vec_id", "dist")))
    rows = found.groupBy("q_id").agg(lists.alias("near")).select(F.col("q_id").alias("vec_id"), F.transform("near", lambda x: x["vec_id"].cast("int")).alias("ids"), F.transform("near", lambda x: x["dist"].cast("float")).alias("dist"))
    write_vectors(rows.select("vec_id", F.col("ids").alias("embedding")), ids_path)
    write_vectors(rows.select("vec_id", F.col("dist").alias("embedding")), dist_path)


def read_truth(spark: SparkSession, ids_path: str, dist_path: str | None = None):
    """(q_id, rank, vec_id, dist) of such files; q_id is the row, dist is null without its file."""
    ids = read_vectors(spark, ids_path).select(F.col("vec_id").alias("q_id"), F.posexplode("embedding").alias("at", "vec_id"))
    if dist_path is None:
        found = ids.withColumn("dist", F.lit(None).cast("double"))
    else:
        dist = read_vectors(spark, dist_path).select(F.col("vec_id").alias("q_id"), F.posexplode("embedding").alias("at", "dist"))
        found = ids.join(dist, ["q_id", "at"])
    return found.select("q_id", (F.col("at") + 1).alias("rank"), F.col("vec_id").cast("long").alias("vec_id"), F.col("dist").cast("double").alias("dist"))


def write_partitions(placed, path: str, suffix: str = ".fvecs", part: str = "part_id") -> list[str]:
    """A file for each partition, ``path`` with its number and ``suffix``, its vectors in order of vec_id; and ``path`` + suffix with
    all, partition after partition. Partitions are few; each is written by many tasks."""
    parts = [r[0] for r in placed.select(part).distinct().orderBy(part).collect()]
    for number in parts:
        write_vectors(placed.where(F.col(part) == number), f"{path}{number}{suffix}")
    place = F.struct(F.col(part), F.col("vec_id"))
    whole = placed.select(place.alias("at"), "embedding").repartitionByRange("at").sortWithinPartitions("at")
    register(placed.sparkSession)
    tagged = whole.select(F.monotonically_increasing_id().alias("vec_id"), "embedding")  # only the order of the parts counts
    tagged.write.format("vecweft.vecfile").mode("overwrite").save(f"{path}{suffix}")
    return [f"{path}{number}{suffix}" for number in parts]
