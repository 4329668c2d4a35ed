"""Queries beside the operators' own, with SQL: columns that SQL can compute, and what must hold of the others' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, chat, langid, packing, pii, quality, sharding, toxicity
from .common import table, written

#: Least shares that must hold; on small tables they are coarse.
ROLES, LANGUAGE, TOXIC, ORDINARY = 0.9, 0.95, 0.75, 0.9

SPACE = r"[\x20\x09-\x0D]+"


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def bpe_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents")).select("doc_id", "decoded_sha256")


def sharding_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's size, and whether slots of its shard are gapless and one more shard takes it only into itself."""
    found = sharding.shard_report(table(spark, sf_dir, "documents"))
    own = Window.partitionBy("shard")
    whole = (F.max("slot").over(own) == F.count(F.lit(1)).over(own) - 1) & (F.size(F.collect_set("slot").over(own)) == F.count(F.lit(1)).over(own))
    return found.select("doc_id", "size", whole.alias("gapless"), ((F.col("grown_shard") == 40) | (F.col("grown_shard") == F.col("shard"))).alias("lawful"), F.col("shard").between(0, 39).alias("in_range"))


def packing_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, gapless): a document's pieces lie end to end from 0, end with its end; and (null, ...) whether sequences do."""
    found = written(packing.pack(table(spark, sf_dir, "documents")), "packed")
    pieces = Window.partitionBy("doc_id").orderBy("piece")
    follows = F.col("start") == F.coalesce(F.sum("length").over(pieces.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    full = F.col("length").between(1, packing.SEQUENCE) & (F.lead("piece").over(pieces).isNull() | (F.col("length") == packing.SEQUENCE))
    docs = found.withColumn("good", follows & full & (F.col("piece") == F.row_number().over(pieces) - 1)).groupBy("doc_id").agg(F.min("good").alias("gapless"))
    places = Window.partitionBy("sequence_id").orderBy("offset")
    lies = F.col("offset") == F.coalesce(F.sum("length").over(places.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fits = F.col("offset") + F.col("length") <= packing.SEQUENCE
    few = F.countDistinct("sequence_id") <= F.ceil(1.1 * F.sum("length") / packing.SEQUENCE) + 1
    whole = found.withColumn("good", lies & fits).groupBy().agg((F.min("good") & few).alias("gapless"))
    return docs.unionByName(whole.select(F.lit(None).cast("long").alias("doc_id"), "gapless"))


def learned_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fact, holds) of what is learned: accuracy on rows that did not teach."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    guess = langid.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null")
    language = guess.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    scored = toxicity.score(docs, labels).where("held_out").join(labels.where("toxic is not null"), "doc_id").groupBy("toxic").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")).alias("right"))
    right = {r["toxic"]: r["right"] for r in scored.collect()}
    conversations = table(spark, sf_dir, "conversations")
    truth = conversations.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("want"))
    roles = chat.recover(conversations).join(truth, "conv_id").agg(F.avg((F.col("roles") == F.col("want")).cast("double"))).first()[0]
    secret = pii.pseudonymise(docs.select("doc_id", "text"), b"key", details=True)
    kept = secret.join(docs.select("doc_id", F.col("text").alias("old")), "doc_id").where("pii_count = 0 and not text <=> old").count()
    held = {"language of held-out texts": language >= LANGUAGE, "held-out toxic texts found": right.get(1, 0) >= TOXIC, "held-out ordinary texts left alone": right.get(0, 0) >= ORDINARY, "roles of conversations": roles >= ROLES, "texts without personal data stay": kept == 0}
    return spark.createDataFrame(list(held.items()), "fact string, holds boolean")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"quality_base": quality_base, "bpe_decoded": bpe_decoded, "sharding_sizes": sharding_sizes, "packing_facts": packing_facts, "learned_facts": learned_facts}


def oracle_sql() -> dict[str, str]:
    return {
        "quality_base": rf"""WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS w FROM documents
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM split) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), grams AS (
  SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM split)
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), range(8) r(k) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(covered.n, 0) > 30 * len(w) AS base_failed
FROM split LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)""",
        "bpe_decoded": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
        "sharding_sizes": "SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, true AS gapless, true AS lawful, true AS in_range FROM documents",
        "packing_facts": "SELECT doc_id, true AS gapless FROM documents UNION ALL SELECT NULL, true",
        "learned_facts": "SELECT fact, true AS holds FROM (VALUES ('language of held-out texts'), ('held-out toxic texts found'), ('held-out ordinary texts left alone'), ('roles of conversations'), ('texts without personal data stay')) v(fact)",
    }
