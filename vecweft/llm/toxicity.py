"""Operator 10: toxicity by class-conditional Kneser-Ney models of character sequences."""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces_of, size_checked, slim, texts_of, written

ORDER, DISCOUNT = 5, 0.75
#: Labels are joined by broadcasting up to so many rows.
BROADCAST_LABELS = 2_000_000
#: Added to a word's length before its log-likelihoods are compared, so that a few letters prove little.
LENGTH_PRIOR = 12
#: Words of a text that its local evidence adds up: those most likely toxic.
EXPRESSIONS = 3
#: Words with a larger difference by length count as likely toxic in a text's share of them.
LIKELY = 0.15
#: A chunk of documents ends after so many of them or so many characters.
CHUNK_DOCS, CHUNK_CHARS = 5000, 8_000_000
#: Log-likelihood ratios are added up as whole multiples of 1 / UNIT, so that sums do not depend on their order.
UNIT = 1 << 32
#: What a score is made of, and in how many bins a unit of it is cut for the calibration.
EVIDENCE = {"local": 200, "whole": 1000, "share": 500}
RIDGE = 1e-3

_WORDS = re.compile(r"[^\W\d_]+")
START, END = "\x02", "\x03"


def fold(id_col: Column) -> Column:
    """0: held out; 1 to 4: counted by the models; 4 calibrates the score by models of 1 to 3 alone."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5


def grams(word: str, order: int) -> list[str]:
    s = START * (order - 1) + word + END
    return [s[i : i + order] for i in range(len(s) - order + 1)]


def gram_counts(labelled: DataFrame, order: int) -> DataFrame:
    """gram, ordinary, toxic: how often each gram of letters occurs in the texts (text, toxic) of either class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 5000):
            words = Counter(), Counter()
            for text, toxic in zip(texts_of(batch), batch.column("toxic").to_pylist(), strict=True):
                words[toxic].update(_WORDS.findall(text.lower()))
            found: dict[str, list[int]] = {}
            for toxic in (0, 1):
                for word, n in words[toxic].items():
                    for gram in grams(word, order):
                        found.setdefault(gram, [0, 0])[toxic] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([n[0] for n in found.values()], pa.int64()), pa.array([n[1] for n in found.values()], pa.int64())], ["gram", "ordinary", "toxic"])

    rows = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(count, "gram string, ordinary long, toxic long")
    return rows.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


class Models:
    """Log-likelihood ratios of letters after their contexts, toxic against ordinary.

    Each class has its own counts at the highest order, discounted; what the discount frees goes to lower
    orders, whose continuation counts (of how many different letters precede a gram) both classes share.
    A gram that neither class has seen is thus as likely in both but for the weights of the backoff.
    """

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.order = len(rows[0][0]) if rows else ORDER
        shared: list[dict[str, float]] = [{} for _ in range(self.order)]
        level: set[str] = {r[0] for r in rows}
        counts = []
        for _ in range(self.order - 1):
            count = Counter(g[1:] for g in level)
            counts.append(count)
            level = set(count)
        uniform = 1 / max(1, len(level))
        for length, count in enumerate(reversed(counts), 1):
            total, types = Counter(), Counter()
            for g, n in count.items():
                total[g[:-1]] += n
                types[g[:-1]] += 1
            for g, n in count.items():
                low = shared[length - 1].get(g[1:], uniform)
                shared[length][g] = (max(n - DISCOUNT, 0) + DISCOUNT * types[g[:-1]] * low) / total[g[:-1]]
        totals, types = (Counter(), Counter()), (Counter(), Counter())
        for g, *n in rows:
            for k in (0, 1):
                totals[k][g[:-1]] += n[k]
                types[k][g[:-1]] += n[k] > 0

        def p(k: int, g: str, n: int) -> float:
            total, low = totals[k][g[:-1]], shared[-1][g[1:]]
            return (max(n - DISCOUNT, 0) + DISCOUNT * types[k][g[:-1]] * low) / total if total else low

        self.seen = {g: math.log(p(1, g, n[1]) / p(0, g, n[0])) for g, *n in rows}
        weight = lambda k, c: DISCOUNT * types[k][c] / totals[k][c] if totals[k][c] else 1.0
        self.backoff = {c: math.log(weight(1, c) / weight(0, c)) for c in {g[:-1] for g in self.seen}}

    def word(self, word: str) -> float:
        """Difference of the log-likelihoods, by length."""
        found = grams(word, self.order)
        return sum(self.seen[g] if g in self.seen else self.backoff.get(g[:-1], 0.0) for g in found) / (len(found) + LENGTH_PRIOR)


def _parents(rows: DataFrame, length: int, *columns: str) -> DataFrame:
    """``rows`` (gram, ...) of grams of ``length`` letters with ``total_c`` and ``types_c`` of their contexts, for each column c."""
    same = Window.partitionBy(F.expr(f"substring(gram, 1, {length - 1})"))
    return rows.select("*", *(f(c).over(same).alias(f"{name}_{c}") for c in columns for name, f in (("total", F.sum), ("types", lambda c: F.sum(F.expr(f"int({c} > 0)"))))))


def model_table(counts: DataFrame, order: int) -> DataFrame:
    """``Models`` as a table, however many grams there are: context, backoff, after (letter, seen), in units of 1 / UNIT."""
    levels = {order: counts}
    for length in range(order - 1, 0, -1):
        levels[length] = levels[length + 1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))
    letters = levels[1].agg(F.sum("n").alias("total_n"), F.count("*").alias("types_n"))
    shared = levels[1].crossJoin(F.broadcast(letters)).withColumn("low", 1 / F.col("types_n"))
    for length in range(1, order):
        if length > 1:
            shared = _parents(levels[length], length, "n").withColumn("suffix", F.expr("substring(gram, 2)")).join(shared, "suffix")
        shared = shared.select(F.col("gram").alias("suffix"), ((F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("types_n") * F.col("low")) / F.col("total_n")).alias("low"))
    both = ("ordinary", "toxic")
    top = _parents(counts, order, *both).withColumn("suffix", F.expr("substring(gram, 2)")).join(shared, "suffix")
    p = {c: F.when(F.col(f"total_{c}") > 0, (F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"types_{c}") * F.col("low")) / F.col(f"total_{c}")).otherwise(F.col("low")) for c in both}
    weight = {c: F.when(F.col(f"total_{c}") > 0, DISCOUNT * F.col(f"types_{c}") / F.col(f"total_{c}")).otherwise(1.0) for c in both}
    ratio = lambda of: F.round(F.log(of["toxic"] / of["ordinary"]) * UNIT).cast("long")
    rows = top.select(F.expr(f"substring(gram, 1, {order - 1})").alias("context"), F.expr(f"substring(gram, {order})").alias("letter"), ratio(p).alias("seen"), ratio(weight).alias("backoff"))
    return rows.groupBy("context").agg(F.first("backoff").alias("backoff"), F.collect_list(F.struct("letter", "seen")).alias("after"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str]]]:
    ids, texts, size = [], [], 0
    for batch in pieces_of(batches, CHUNK_DOCS):
        for i, text in zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), texts_of(batch), strict=True):
            ids.append(i)
            texts.append(text)
            size += len(text)
            if len(ids) == CHUNK_DOCS or size >= CHUNK_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits as four planes of bytes, which compress better."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def chunked(docs: DataFrame, order: int) -> DataFrame:
    """chunk, context, words: each context of letters in a chunk of documents once, and a row without context with the chunk's words.

    ``words`` has the ids, the distinct words, and of each the documents and how often they have it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=4).compress
        for n, (ids, texts) in enumerate(_chunks(batches)):
            place: dict[str, int] = {}
            found, size = [], []
            for text in texts:
                words = _WORDS.findall(text.lower())
                found.append(np.array([place.setdefault(w, len(place)) for w in words], np.int64))
                size.append(len(words))
            ordered = sorted(place)
            rank = np.empty(len(place), np.int64)
            rank[[place[w] for w in ordered]] = np.arange(len(place))
            pairs, times = np.unique(rank[np.concatenate(found)] * CHUNK_DOCS + np.repeat(np.arange(len(ids)), size), return_counts=True)
            contexts = list({g[:-1] for word in place for g in grams(word, order)})
            packed = compress(pickle.dumps((ids, " ".join(ordered), _planes(np.diff(pairs, prepend=0)), _planes(times))))
            rows = len(contexts) + 1
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() << 32 | n] * rows, pa.int64()), pa.array([None, *contexts], pa.string()), pa.array([packed] + [None] * (rows - 1), pa.binary())], ["chunk", "context", "words"])

    return docs.select("doc_id", "text").mapInArrow(run, "chunk long, context string, words binary")


class _Seen(dict):
    """Ratios of grams; one that no class has seen gets its context's backoff, or 0."""

    def __init__(self, backoff: dict[str, int]):
        super().__init__()
        self.backoff = backoff

    def __missing__(self, gram: str) -> int:
        value = self[gram] = self.backoff.get(gram[:-1], 0)
        return value


def evidence(docs: DataFrame, counts: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id and EVIDENCE, which is null for a text without words.

    local: the EXPRESSIONS largest differences of log-likelihoods, by length, over a text's words, added;
    whole: the difference for the whole text, each occurrence of each word, by its length; share: of all
    occurrences of words, those with a difference above LIKELY.

    No process holds the model: each chunk of documents meets, by a join, what the model knows of its own contexts.
    """
    found = written(chunked(docs, order), "chunks", 2000)
    known = found.where("context is not null").select(F.col("chunk").alias("of_chunk"), "context").join(model_table(counts, order), "context")

    def run(chunk: pa.Table, known: pa.Table) -> pa.Table:
        import zstandard

        if not chunk.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), **{c: pa.array([], pa.float64()) for c in EVIDENCE}})
        ids, words, *planes = pickle.loads(zstandard.ZstdDecompressor().decompress(chunk.column("words")[0].as_py()))
        words, (pairs, times) = words.split(), map(_numbers, planes)
        place, where = np.divmod(np.cumsum(pairs), CHUNK_DOCS)
        contexts, after = known.column("context").to_pylist(), known.column("after").combine_chunks()
        backoff = dict(zip(contexts, known.column("backoff").to_pylist(), strict=True))
        letters = after.flatten()
        follows = np.repeat(np.arange(len(contexts)), np.diff(after.offsets.to_numpy()) if len(contexts) else 0).tolist()
        seen = _Seen(backoff)
        seen.update((contexts[i] + letter, value) for i, letter, value in zip(follows, letters.field("letter").to_pylist(), letters.field("seen").to_pylist(), strict=True))
        ratio, size = np.empty(len(words)), np.empty(len(words))
        for i, word in enumerate(words):
            found = grams(word, order)
            ratio[i], size[i] = sum(map(seen.__getitem__, found)), len(found)
        by_length = (ratio / UNIT / (size + LENGTH_PRIOR))[place]
        best = np.lexsort((-by_length, where))
        n = np.bincount(where, minlength=len(ids))
        rank = np.arange(len(best)) - np.repeat(np.cumsum(n) - n, n)
        top = best[rank < EXPRESSIONS]
        added = lambda values: np.bincount(where, times * values, len(ids))
        columns = {
            "local": np.bincount(where[top], by_length[top], len(ids)),
            "whole": added(ratio[place]) / UNIT / (added(size[place]) + LENGTH_PRIOR),
            "share": added(by_length > LIKELY) / (added(1) + LENGTH_PRIOR),
        }
        return pa.table({"doc_id": pa.array(ids, pa.int64()), **{c: pa.array(v, pa.float64(), mask=n == 0) for c, v in columns.items()}})

    return found.where("context is null").select("chunk", "words").groupBy("chunk").cogroup(known.groupBy("of_chunk")).applyInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in EVIDENCE))


def calibrate(binned: list[tuple[float, ...]]) -> tuple[list[float], float]:
    """Slopes and offset of a logistic curve for rows (*evidence, ordinary, toxic). Evidence with a negative slope is left out."""
    rows = np.array(binned, float).reshape(-1, len(EVIDENCE) + 2)
    x, n = rows[:, : len(EVIDENCE)], rows[:, len(EVIDENCE) :]
    slopes = np.zeros(len(EVIDENCE))
    if not n.sum(0).all():
        slopes[0] = 10.0
        return slopes.tolist(), -10.0 * x[:, 0].max(initial=0.0) - 1.0
    used = list(range(len(EVIDENCE)))
    weight = n.sum(1) / n.sum()
    while used:
        mean = weight @ x[:, used]
        spread = np.sqrt(weight @ (x[:, used] - mean) ** 2) + 1e-9
        z = np.c_[(x[:, used] - mean) / spread, np.ones(len(x))]
        ridge = np.array([RIDGE] * len(used) + [1e-9])
        b = np.zeros(len(used) + 1)
        for _ in range(60):
            q = 1 / (1 + np.exp(-np.clip(z @ b, -60, 60)))
            hessian = (z * (weight * q * (1 - q))[:, None]).T @ z + np.diag(ridge)
            b += np.clip(np.linalg.solve(hessian, z.T @ (n[:, 1] / n.sum() - weight * q) - ridge * b), -5, 5)
        if (b[:-1] >= 0).all():
            slopes[used] = b[:-1] / spread
            return slopes.tolist(), float(b[-1] - slopes[used] @ mean)
        used.pop(int(np.argmin(b[:-1])))
    return slopes.tolist(), math.log(n[:, 1].sum() / n[:, 0].sum())


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Models learn from all labelled documents that are not held out, each row once, and the calibration from
    the quarter of them in fold 4, as models of the others see it; labels other than 0 and 1 teach nothing. A score weighs the few words whose length-normalised toxic
    log-likelihoods exceed the ordinary ones most, since a long text may be toxic by one expression, the
    length-normalised likelihoods of the whole text, and the share of its words that are likely toxic. Null
    and empty texts, and texts without letters, get the lowest score, 0. If a class has no labelled document,
    nothing is predicted toxic. Ids are integers; a null id has no label, and a null label teaches nothing. Repeated rows get the same answer each; other columns
    are ignored.
    """
    docs = slim(docs, id_col, text_col, whole=True)
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(fold(F.col("doc_id")) != 0)
    known = size_checked(known.distinct(), BROADCAST_LABELS)
    labelled = docs.join(known, "doc_id")
    part = fold(F.col("doc_id"))
    taught, last = (written(gram_counts(labelled.where(which), order), "grams") for which in (part < 4, part == 4))
    unseen = evidence(docs.where(part == 4).join(known, "doc_id", "left_semi"), taught, order)
    bins = unseen.join(known, "doc_id").where("local is not null").groupBy(*(F.floor(F.col(c) * n).alias(c) for c, n in EVIDENCE.items())).agg(F.sum(1 - F.col("toxic")).alias("ordinary"), F.sum("toxic").alias("toxic"))
    slopes, offset = calibrate([(*((r[c] + 0.5) / n for c, n in EVIDENCE.items()), r["ordinary"], r["toxic"]) for r in bins.orderBy(*EVIDENCE).collect()])
    counts = written(taught.unionByName(last).groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")), "grams")
    found = written(evidence(docs, counts, order), "evidence")
    curve = F.lit(offset)
    for c, slope in zip(EVIDENCE, slopes, strict=True):
        curve += F.col(c) * F.lit(slope)
    scored = found.withColumn("score", F.coalesce(1 / (1 + F.exp(-curve)), F.lit(0.0)))
    return scored.select("doc_id", (part == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
