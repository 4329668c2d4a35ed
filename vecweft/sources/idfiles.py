"""Binary files of overlapping partitions, and tables of measurements.

``assignments``: uint32 n, then n times (uint64 global id, uint32 cluster). ``idmaps``: uint32 m, then for each cluster uint64
n and n uint64 global ids, in order of the local id. ``locals``: uint64 n, then for each global id uint32 size and size
times (uint32 cluster, uint64 local id). They are for exchange; inside Spark the table (global_id, cid, local_id) is Parquet.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vecfiles import opened

ASSIGNMENT = np.dtype([("global_id", "<u8"), ("cid", "<u4")])
PLACE = np.dtype([("cid", "<u4"), ("local_id", "<u8")])
ROWS = "global_id long, cid int, local_id long"


def _read(path: str) -> bytes:
    system, plain = opened(path)
    with system.open_input_file(plain) as f:
        return f.read()


def _write(path: str, parts) -> None:
    system, plain = opened(path)
    with system.open_output_stream(plain) as f:
        for part in parts:
            f.write(part)


def write_assignments(assignments: DataFrame, path: str) -> None:
    rows = assignments.select("global_id", "cid").orderBy("global_id", "cid").toLocalIterator(True)
    n = assignments.count()
    _write(path, (x for part in ([struct.pack("<I", n)], (struct.pack("<QI", r[0], r[1]) for r in rows)) for x in part))


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    data = _read(path)
    n = struct.unpack_from("<I", data)[0]
    if len(data) < 4 + n * ASSIGNMENT.itemsize:
        raise ValueError(f"{path}: cut off")
    rows = np.frombuffer(data, ASSIGNMENT, n, 4)
    return spark.createDataFrame([(int(g), int(c)) for g, c in rows.tolist()], "global_id long, cid int")


def write_idmaps(placed: DataFrame, m: int, path: str) -> None:
    def parts():
        yield struct.pack("<I", m)
        for cid in range(m):
            ids = [r[0] for r in placed.where(F.col("cid") == cid).orderBy("local_id").select("global_id").toLocalIterator()]
            yield struct.pack("<Q", len(ids)) + np.array(ids, "<u8").tobytes()

    _write(path, parts())


def read_idmaps(spark: SparkSession, path: str) -> DataFrame:
    data, at, rows = _read(path), 4, []
    for cid in range(struct.unpack_from("<I", data)[0]):
        n = struct.unpack_from("<Q", data, at)[0]
        rows += [(int(g), cid, i) for i, g in enumerate(np.frombuffer(data, "<u8", n, at + 8))]
        at += 8 + 8 * n
    return spark.createDataFrame(rows, ROWS)


def write_locals(placed: DataFrame, path: str) -> None:
    grouped = placed.groupBy("global_id").agg(F.sort_array(F.collect_list(F.struct("cid", "local_id"))).alias("at"))
    n = (placed.agg(F.max("global_id")).first()[0] or -1) + 1

    def parts():
        yield struct.pack("<Q", n)
        done = 0
        for row in grouped.orderBy("global_id").toLocalIterator():
            yield struct.pack("<I", 0) * (row["global_id"] - done)
            yield struct.pack("<I", len(row["at"])) + np.array([tuple(x) for x in row["at"]], PLACE).tobytes()
            done = row["global_id"] + 1

    _write(path, parts())


def read_locals(spark: SparkSession, path: str) -> DataFrame:
    data, at, rows = _read(path), 8, []
    for global_id in range(struct.unpack_from("<Q", data)[0]):
        n = struct.unpack_from("<I", data, at)[0]
        rows += [(global_id, int(c), int(i)) for c, i in np.frombuffer(data, PLACE, n, at + 4).tolist()]
        at += 4 + n * PLACE.itemsize
    return spark.createDataFrame(rows, ROWS)


def local_to_global(ids: DataFrame, placed: DataFrame) -> DataFrame:
    """``ids`` (cid, local_id) with global_id, null where there is none."""
    return ids.join(placed.select("cid", "local_id", "global_id"), ["cid", "local_id"], "left")


def read_performance(spark: SparkSession, path: str) -> DataFrame:
    """Rows (L, recall, QPS), ordered by recall and then by speed."""
    return spark.read.csv(path, header=True, schema="L int, recall double, QPS double").orderBy("recall", "QPS")


def write_performance(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.select("L", "recall", "QPS").coalesce(1).write.mode("append" if append else "overwrite").csv(path, header=True)


def read_merge_times(spark: SparkSession, path: str) -> DataFrame:
    """(config, seconds) of log files: the file's name, and the number in a line ``Merge time: <number> s``."""
    pattern = r"Merge time:\s*([0-9.]+)\s*s"
    lines = spark.read.text(path).withColumn("config", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1))
    found = lines.select("config", F.regexp_extract("value", pattern, 1).alias("t")).where("t <> ''")
    return found.select("config", F.expr("try_cast(t as double)").alias("seconds"))


