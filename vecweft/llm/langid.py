"""Operator 6: language identification by compression with a dictionary for each language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces_of, slim, texts_of

#: The classifier is fitted on a bounded sample of rows: of each language, whole documents in order of a seeded hash, at most
#: so many, until they have so many bytes.
SAMPLE_DOCS, SAMPLE_BYTES = 96, 64 << 10
SEED = 11
LEVEL, MIN_MATCH = 6, 4
#: Texts are compressed in blocks of words of about so many bytes, so that long texts lean on the dictionary too.
BLOCK = 1024
#: Each block follows so many bytes of the dictionary's own text, whose cost is taken off again: a short block alone
#: would be stored as it is, at equal size for all languages.
LEAD = 64
#: Where the best language of a single block saves too little, sizes after so many leads are added up: whole bytes are too
#: coarse for a few words.
LEADS = 16
#: Rejected: texts whose best language saves less than this share of the second best's bytes.
MARGIN = 0.004
UNKNOWN = "und"

_WORDS = re.compile(r"[^\W\d_]+")


def letters_only(text: str) -> bytes:
    """Lower-cased runs of letters, a space between them."""
    return (" ".join(_WORDS.findall(text.lower())) + " ").encode().lstrip()


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 4 == 2


def has_letter(text: str) -> bool:
    """A character of Unicode's category L."""
    return any(map(str.isalpha, text))


class Compressors:
    """A compressor for each language, with the language's sample as raw content dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        self.by = []
        for lang, data in dictionaries.items():
            settings = z.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
            raw = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=settings)
            compress = z.ZstdCompressor(dict_data=raw, compression_params=settings).compress
            leads = [data[len(data) * (LEADS // 2 + i) % (LEADS * len(data)) // LEADS :][:LEAD] + b" " for i in range(LEADS)]
            self.by.append((lang, compress, [(lead, len(compress(lead))) for lead in leads]))

    def sizes(self, blocks: list[bytes], leads: int) -> list[tuple[int, int, str]]:
        """(bytes, place, language) from the smallest on, added up over the first ``leads`` leads."""
        found = []
        for place, (lang, compress, by_lead) in enumerate(self.by):
            size = sum(max(1, sum([len(compress(lead + b)) for b in blocks]) - len(blocks) * own) for lead, own in by_lead[:leads])
            found.append((size, place, lang))
        return sorted(found)

    def predict(self, text: str) -> tuple[str, float, float]:
        """Language, score (0.5 to 1 for a language; how clear the choice is) and margin."""
        data = letters_only(text)
        if not data or not self.by or not has_letter(text):
            return UNKNOWN, 0.0, 0.0
        blocks, at = [], 0
        while at < len(data):
            end = data.find(b" ", at + BLOCK) + 1 or len(data)
            if end > at + 2 * BLOCK:
                end = at + BLOCK
            blocks.append(data[at:end])
            at = end
        for leads in (1, LEADS):
            sizes = self.sizes(blocks, leads)
            best, _, lang = sizes[0]
            second = sizes[1][0] if len(sizes) > 1 else 2 * best
            margin = (second - best) / second
            if margin >= MARGIN or len(blocks) > 1:
                break
        return lang, 1 / (1 + (1 - margin) ** 20), margin


def fit(docs: DataFrame, lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionaries from documents (doc_id, text, language) with a language and a letter, held-out ones left out.

    At most SAMPLE_DOCS documents of a language reach the driver, the least by a seeded hash of id and text, each
    repeated one once; whole ones are taken until there are SAMPLE_BYTES. The languages come in order of their documents' count,
    which decides between equal sizes.
    """
    known = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col("doc_id"))).select(F.col(lang_col).alias("lang"), "text", F.xxhash64(F.lit(SEED), "doc_id", "text").alias("at"))
    lettered = known.where(F.col("text").rlike(r"\p{L}"))
    least = F.row_number().over(Window.partitionBy("lang").orderBy("at"))
    chosen = lettered.select("lang", "at").distinct().withColumn("n", least).where(F.col("n") <= SAMPLE_DOCS).drop("n")
    rows = lettered.join(F.broadcast(chosen), ["lang", "at"]).groupBy("lang", "at").agg(F.min("text").alias("text")).collect()
    found: dict[str, list[bytes]] = {row["lang"]: [] for row in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    for row in sorted(rows, key=lambda r: (r["lang"], r["at"])):
        data, parts = letters_only(row["text"]), found[row["lang"]]
        if data not in parts and sum(map(len, parts)) < SAMPLE_BYTES:
            parts.append(data)
    return {lang: b" ".join(parts) for lang, parts in found.items() if parts}


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", margin: float = MARGIN) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, margin, rejected.

    Each whole text is compressed with every language's dictionary, and the smallest result names the
    language; equal sizes go to the language with more documents to learn from. ``rejected``: no letter, or a margin under
    ``margin``. Null and empty texts, and texts without a letter (Unicode's category L), are ``und`` with score 0; so is
    every text if no row has a language to learn from. Ids are integers. Rows with a null id are predicted, and learned from as
    ids that are empty texts. Repeated rows get the same answer each; other columns are ignored.
    """
    rows = slim(docs, id_col, text_col, whole=True)
    dictionaries = fit(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = Compressors(dictionaries).predict
        for batch in pieces_of(batches, 1000):
            langs, scores, margins = zip(*map(predict, texts_of(batch)), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())], ["doc_id", "lang_pred", "score", "margin"])

    found = rows.mapInArrow(run, "doc_id long, lang_pred string, score double, margin double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", ((F.col("lang_pred") == UNKNOWN) | (F.col("margin") < margin)).alias("rejected"))


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs``, all columns, that ``identify`` does not reject: each row by its own text, whatever its id."""
    dictionaries = fit(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = Compressors(dictionaries).predict
        for batch in pieces_of(batches, 1000):
            found = [predict(t or "") for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and m >= margin for lang, _, m in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
