"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slim(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """Only id and text, as ``doc_id`` and ``text``: other columns, whatever their names, cannot clash. With ``whole`` ids must be
    integers, and become long."""
    if whole:
        whole_ids(docs, id_col)
    id_ = F.col(id_col).cast("long") if whole else F.col(id_col)
    return docs.select(id_.alias("doc_id"), F.col(text_col).alias("text"))


def whole_ids(docs: DataFrame, id_col: str) -> None:
    kind = dict(docs.dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"{id_col} holds {kind}; this operator needs integer ids")


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of an Arrow batch; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def pieces_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, which bounds what a Python worker holds."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def size_checked(df: DataFrame, rows: int) -> DataFrame:
    """Hint ``df`` for broadcasting only if it has at most ``rows`` rows; beyond that Spark joins by shuffling."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class Memory(dict):
    """Remembers what ``make`` returns for a key. When it holds ``most`` it becomes the last generation, from which keys that
    come again are taken over; so what is frequent stays, and never more than two generations are held."""

    def __init__(self, make: Callable, most: int, largest: int | None = None):
        super().__init__()
        self.make, self.most, self.largest, self.last = make, most, largest, {}

    def __missing__(self, key):
        found = self.last.get(key)
        if found is None:
            found = self.make(key)
            if self.largest and len(key) > self.largest:
                return found
        if len(self) >= self.most:
            self.last = dict(self)
            self.clear()
        self[key] = found
        return found
