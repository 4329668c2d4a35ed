"""Vector tables under change: upserts, soft deletes, slots, look-ups. Tables are immutable; each operation returns a new one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, changes: DataFrame, id_col: str = "vec_id", version: str = "version") -> DataFrame:
    """For each id the row of the highest version; the change wins at equal versions."""
    rows = base.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(version), F.desc("__new")))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place", "__new")


def delete(base: DataFrame, ids: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return base.join(ids.select(id_col), id_col, "left_anti")


def keep_only(base: DataFrame, ids: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """The allow-list filter."""
    return base.join(ids.select(id_col).distinct(), id_col, "left_semi")


def _marked(base: DataFrame, ids: DataFrame, to: bool, id_col: str) -> DataFrame:
    ids = ids.select(id_col).distinct()
    wrong = ids.join(base.where(F.col("deleted") != to), id_col, "left_anti").first()
    if wrong is not None:
        raise ValueError(f"{wrong[0]} is not there, or its deletion mark is set already" if to else f"{wrong[0]} is not marked as deleted")
    return base.join(ids.withColumn("__hit", F.lit(True)), id_col, "left").withColumn("deleted", F.when(F.col("__hit"), F.lit(to)).otherwise(F.col("deleted"))).drop("__hit")


def mark_deleted(base: DataFrame, ids: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Set the column ``deleted``; an id that is unknown or marked already raises an error."""
    return _marked(base, ids, True, id_col)


def unmark_deleted(base: DataFrame, ids: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return _marked(base, ids, False, id_col)


def replace_deleted(base: DataFrame, new: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Insert rows into the slots of rows marked as deleted, the smallest ids first; further rows are appended.

    Live rows of the same id are updated in place and use no slot.
    """
    fresh = new.join(base.where("not deleted").select(id_col), id_col, "left_anti")
    n = fresh.count()
    freed = base.where("deleted").select(id_col).orderBy(id_col).limit(n)
    rest = base.join(freed, id_col, "left_anti").join(new.select(id_col), id_col, "left_anti")
    return rest.unionByName(new.withColumn("deleted", F.lit(False)), allowMissingColumns=True)


def get_items(base: DataFrame, ids: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """The rows of the ids; an id that is missing or deleted raises an error."""
    live = base.where("not deleted") if "deleted" in base.columns else base
    ids = ids.select(id_col).distinct()
    missing = ids.join(live, id_col, "left_anti").first()
    if missing is not None:
        raise KeyError(f"id {missing[0]} not found")
    return live.join(ids, id_col, "left_semi")


def with_objects(found: DataFrame, objects: DataFrame) -> DataFrame:
    """Results (q_id, rank, vec_id, dist) with whatever ``objects`` holds for a vec_id."""
    return found.join(objects, "vec_id", "left")
