"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The session's setting of how many rows a Python worker gets at once.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session has none and all runs on this machine (tests) a temporary one is set; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="vecweft-"))
    return context._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, and survives lost executors.

    ``batch_rows`` holds, while it is written, for the batches that Python workers get: rows of long texts or sets come in small
    ones. The tables of a session stay until the folder is cleared, as recovery may read them until the result is used.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(BATCH_ROWS)
    try:
        if batch_rows:
            spark.conf.set(BATCH_ROWS, str(min(batch_rows, int(before)) if int(before) > 0 else batch_rows))
        df.write.parquet(path)
    finally:
        if batch_rows:
            spark.conf.set(BATCH_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)
