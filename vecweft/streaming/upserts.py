"""A live vector table: micro-batches of upserts and deletions, appended as they come and compacted now and then.

``changes/batch=N`` has the newest change of each id in micro-batch N, and ``base/upto=N`` the whole table after it. A batch
costs what it brings; every so many batches the table is written anew, and what lies before the last but one is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import tables

#: op is ``upsert`` or ``delete``; of changes to an id the one of the highest version counts.
CHANGES = "vec_id long, embedding array<float>, op string, version long"
TABLE = "vec_id long, embedding array<float>, version long, deleted boolean"
#: Batches between two compactions.
COMPACT_EVERY = 16


def newest_changes(changes: DataFrame) -> DataFrame:
    """(vec_id, embedding, version, deleted): one row for each id."""
    rows = changes.select("vec_id", "embedding", "version", (F.col("op") == "delete").alias("deleted"))
    return tables.upsert(rows.limit(0), rows)


def apply_changes(base: DataFrame, changes: DataFrame) -> DataFrame:
    """``base`` (vec_id, embedding, version, deleted) after the changes."""
    return tables.upsert(base, newest_changes(changes))


def _folders(spark: SparkSession, path: str, kind: str) -> dict[int, str]:
    """The complete folders ``kind``=number below the path, by number: a listing, no data."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return {}
    found = {}
    for status in system.listStatus(at):
        name, _, number = status.getPath().getName().partition("=")
        if name == kind and number.isdigit() and system.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found[int(number)] = status.getPath().toString()
    return found


def current(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The table now, or after batch ``upto``: the last base, and what was appended since."""
    bases = {n: p for n, p in _folders(spark, f"{path}/base", "upto").items() if upto is None or n <= upto}
    last = max(bases, default=-1)
    base = spark.read.schema(TABLE).parquet(bases[last]) if bases else spark.createDataFrame([], TABLE)
    since = [p for n, p in sorted(_folders(spark, f"{path}/changes", "batch").items()) if n > last and (upto is None or n <= upto)]
    return tables.upsert(base, spark.read.schema(TABLE).parquet(*since)) if since else base


def compact(spark: SparkSession, path: str, number: int) -> None:
    """Write the table after batch ``number``, and remove what the last but one base makes needless."""
    current(spark, path, number).write.mode("overwrite").parquet(f"{path}/base/upto={number}")
    bases = sorted(_folders(spark, f"{path}/base", "upto"))
    kept = bases[-2] if len(bases) > 1 else -1
    system = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for kind, name, least in (("base", "upto", kept), ("changes", "batch", kept + 1)):
        for n, folder in _folders(spark, f"{path}/{kind}", name).items():
            if n < least:
                system.delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)


def start(changes: DataFrame, path: str, checkpoint: str, available_now: bool = False, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Append a stream of changes to the table at ``path``. A batch that is repeated after a failure replaces its folder."""

    def append(batch: DataFrame, number: int) -> None:
        newest_changes(batch).write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
        if number % compact_every == compact_every - 1:
            compact(batch.sparkSession, path, number)

    writer = changes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
