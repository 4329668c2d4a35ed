"""Operator 3: quality rules by divergence from language references."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces_of, slim, texts_of

SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"
WINDOW = 8
#: Common words of a language, by its documents' counts.
COMMON = 64
#: A histogram of fewer characters or words than these says too little, and its rule passes.
LEAST_CHARS, LEAST_WORDS = 220, 40
#: Largest Jensen-Shannon distances (0 to 1) from the closest language that are kept.
MOST_CHARS, MOST_WORDS = 0.29, 0.42
#: Added to the second, over the root of the number of words: a short histogram is far from any reference by chance.
NOISE = 0.6

#: Character classes: a class for each byte of UTF-8; bytes that continue a character count nowhere.
CLASSES = ("lower", "upper", "digit", "space", "break", "punctuation", "symbol", "beyond ASCII", "control")
_CLASS = np.full(256, len(CLASSES), np.intp)
for _class, _bytes in (
    (8, [*range(32), 127]), (6, range(33, 127)), (0, range(97, 123)), (1, range(65, 91)), (2, range(48, 58)), (3, [32]), (4, [9, 10, 11, 12, 13]), (5, b".,;:?'\"()-"), (7, range(0xC0, 256)),
):
    _CLASS[list(_bytes)] = _class


def class_counts(data: bytes) -> np.ndarray:
    return np.bincount(_CLASS, np.bincount(np.frombuffer(data, np.uint8), minlength=256), len(CLASSES) + 1)[:-1]


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for i in range(window):
        h = (h ^ ids[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(np.isin(h, twice))
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances (base 2, 0 to 1) of the histogram p from each row of q."""
    p, q = p / max(p.sum(), 1), q / np.maximum(q.sum(-1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        of = lambda x: np.where(x > 0, x * np.log2(x / m), 0).sum(-1)
        return np.sqrt(np.clip((of(np.broadcast_to(p, q.shape)) + of(q)) / 2, 0, 1))


def references(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """Rows (lang, kind, key, n) from all documents (text, lang): counts of each character class, of the
    ``common`` most frequent words (ties by word) and, under a null key, of all words of each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 5000):
            chars: dict[str, np.ndarray] = {}
            words: dict[str, Counter] = {}
            for text, lang in zip(texts_of(batch), batch.column("lang").to_pylist(), strict=True):
                data = text.encode()
                chars[lang] = chars.get(lang, 0) + class_counts(data)
                words.setdefault(lang, Counter()).update(data.lower().split())
            rows = [(lang, "class", CLASSES[i], int(n)) for lang, found in chars.items() for i, n in enumerate(found) if n]
            rows += [(lang, "words", None, sum(found.values())) for lang, found in words.items()]
            rows += [(lang, "word", w.decode(), n) for lang, found in words.items() for w, n in found.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(("lang", "kind", "key", "n"), r, strict=True)) for r in rows], pa.schema([("lang", pa.string()), ("kind", pa.string()), ("key", pa.string()), ("n", pa.int64())]))

    counts = docs.where("lang is not null").select("text", "lang").mapInArrow(count, "lang string, kind string, key string, n long")
    counts = counts.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key"))
    return counts.withColumn("place", place).where(F.col("place") <= max(common, len(CLASSES))).drop("place")


class References:
    """Histograms of the languages, over character classes and over the union of their common words and the rest."""

    def __init__(self, rows: list[tuple[str, str, str | None, int]]):
        self.langs = sorted({r[0] for r in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        self.chars = np.zeros((len(at), len(CLASSES)))
        self.words: list[dict[bytes, int]] = [{} for _ in at]
        total = [0] * len(at)
        for lang, kind, key, n in rows:
            if kind == "class":
                self.chars[at[lang], CLASSES.index(key)] = n
            elif kind == "words":
                total[at[lang]] = n
            else:
                self.words[at[lang]][key.encode()] = n
        self.keys = [list(w) for w in self.words]
        self.hists = [np.array([[*w.values(), max(0, total[i] - sum(w.values()))]], float) for i, w in enumerate(self.words)]

    def distances(self, chars: np.ndarray, words: Counter, n_words: int) -> tuple[float, float]:
        """From the language that is closest by words: distance of character classes and of common words."""
        if not self.langs:
            return 0.0, 0.0
        by_word = []
        for keys, hist in zip(self.keys, self.hists, strict=True):
            found = [words[k] for k in keys]
            by_word.append(float(divergence(np.array([*found, n_words - sum(found)], float), hist)[0]))
        best = int(np.argmin(by_word))
        return float(divergence(chars.astype(float), self.chars[best : best + 1])[0]), by_word[best]


def rate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_chars: int = LEAST_CHARS, least_words: int = LEAST_WORDS, most_chars: float = MOST_CHARS, most_words: float = MOST_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, char_distance, word_distance.

    The references are counted over all documents that have a language; a document is held against each, so
    its own language column does not matter to its verdict. It is kept if it passes the base rules and lies
    within ``most_chars`` and ``most_words`` (and an allowance for few words) of the language closest to it by words; a histogram of fewer than
    ``least_chars`` characters or ``least_words`` words passes. Null texts have no words, so they
    fail the base rules; with no reference at all the base rules decide. The references that reach the
    driver are COMMON words and the classes for each language. Repeated rows get the same
    answer each; other columns are ignored.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = References([tuple(r) for r in references(rows).select("lang", "kind", "key", "n").collect()])
    names = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "char_distance": "double", "word_distance": "double"}
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}

    def one(text: str) -> tuple:
        data = text.encode()
        words = data.split()
        n, ids = len(words), {}
        repeat = repeated_words(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, n)) if n else 0
        seen, dup = set(), 0
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif line.strip(SPACES):
                seen.add(line)
        symbols = sum(map(text.count, SYMBOLS))
        word_chars = len(text) - sum(map(text.count, SPACES))
        failed = n < 20 or 100 * repeat > 30 * n
        chars, by_word = known.distances(class_counts(data), Counter(data.lower().split()), n) if n else (0.0, 0.0)
        good = (len(text) < least_chars or chars <= most_chars) and (n < least_words or by_word <= most_words + NOISE / n**0.5)
        return n, word_chars, symbols, dup, repeat, failed, good and not failed, chars, by_word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 1000):
            found = list(zip(*map(one, texts_of(batch)), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(v, kinds[k]) for v, k in zip(found, names.values(), strict=True))], ["doc_id", *names])

    return slim(docs, id_col, text_col, whole=True).mapInArrow(run, "doc_id long, " + ", ".join(f"{k} {v}" for k, v in names.items()))
