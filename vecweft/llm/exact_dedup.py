"""Operator 5: exact deduplication by skew-safe combining, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import size_checked, slim

#: Rows of one text that meet in a task; a text with more is dealt over salts, so many rows each.
HOT_ROWS = 10_000
#: Hot texts (a HOT_ROWS-th of the rows at most) are looked up by broadcasting up to so many; more by a shuffled join.
BROADCAST_HOT = 500_000


def _salted(rows: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (text, ...) with digest, salts (how many its text is dealt over) and salt; and the hot texts (hash, salts).

    A hash of 64 bits only decides how many salts there are. The salt is any row number: each salt has its row in a look-up, so it
    need not be the same when rows are read again.
    """
    hashed = rows.withColumn("hash", F.xxhash64("text"))
    hot = hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("hash", F.ceil(F.col("n") / hot_rows).cast("long").alias("salts"))
    hot = size_checked(hot, BROADCAST_HOT)
    found = hashed.join(hot, "hash", "left").withColumn("salts", F.coalesce("salts", F.lit(1).cast("long")))
    return found.withColumn("digest", F.sha2("text", 256)).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.col("salts"))), hot


def _combined(salted: DataFrame, first: dict[str, Column], then: dict[str, Column]) -> DataFrame:
    """(digest, text, salts, ...): rows grouped by digest and whole text, in three stages.

    1. Each task combines its own rows (the map side of the first aggregation); 2. rows of one digest, salt and text meet;
    3. the winners of hot texts' salts are combined globally. Texts that are not hot have one salt, and are whole after stage 2.
    """
    groups = salted.groupBy("digest", "salts", "salt", "text").agg(*(c.alias(n) for n, c in first.items()))
    winners = groups.where("salts > 1").groupBy("digest", "salts", "text").agg(*(c.alias(n) for n, c in then.items()))
    return groups.where("salts = 1").drop("salt").unionByName(winners)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their code points are; null counts as empty. Of equal texts the row with the
    largest id stays. Combining has three stages, each by digest *and* whole text (see ``_combined``): local, salted and global.
    A text that more than ``hot_rows`` rows have is dealt over as many salts as keep a salt near ``hot_rows``; texts of
    others are shuffled once.

    Results return to the documents by digest and salt, without texts. Should two texts ever share a SHA-256, the query stops with
    an error rather than merging them.

    An empty table gives an empty result. A null id is a row like others and is kept only if all ids of
    its text are null. Rows repeated with the same id share group and verdict. Ids are of any type that has an order. Other
    columns are ignored.
    """
    rows = slim(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    salted, _ = _salted(rows, hot_rows)
    found = _combined(salted, {"top": F.max("doc_id"), "n": F.count(F.lit(1))}, {"top": F.max("top"), "n": F.sum("n")})
    lookup = found.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("top").alias("keep_id"), F.max("n").alias("n"), F.max("salts").alias("salts"))
    one = F.when(F.col("texts") == 1, F.col("n")).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("long"))
    lookup = lookup.select("digest", "keep_id", one.alias("group_size"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    return (
        salted.select("doc_id", "digest", "salt")
        .join(lookup, ["digest", "salt"])
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))
    )


def _has_order(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_has_order(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_order(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row of ``docs``, all columns, of each text: of the largest id, and of rows that repeat it the one whose columns come last
    in their order (columns of types without an order, such as maps, do not count). The rows themselves are combined, in the stages
    of ``_combined``, so nothing is joined back. Columns may have any names."""
    others = [c for c in docs.columns if c != text_col]
    ordered = [id_col, *(c for c in others if c != id_col and _has_order(docs.schema[c].dataType))]
    row = F.struct(*(F.col(f"`{c}`") for c in others))
    rank = F.struct(*(F.col(f"`{c}`") for c in ordered), F.col(f"`{text_col}`").isNotNull())
    rows = docs.select(row.alias("row"), rank.alias("rank"), F.col(f"`{text_col}`").isNull().alias("none"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    best = F.max(F.struct("rank", "none")) if len(ordered) == len(others) else F.max_by(F.struct("rank", "none", "row"), F.struct("rank", "none"))
    again = F.max("best") if len(ordered) == len(others) else F.max_by("best", F.struct("best.rank", "best.none"))
    found = _combined(_salted(rows, hot_rows)[0], {"best": best}, {"best": again})
    if len(ordered) == len(others):
        fields = {c: F.col("best.rank").getField(f"{c}") for c in ordered}
    else:
        fields = {c: F.col("best.row").getField(f"{c}") for c in others}
    fields[text_col] = F.when(~F.col("best.none"), F.col("text"))
    return found.select(*(fields[c].alias(c) for c in docs.columns))


SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
