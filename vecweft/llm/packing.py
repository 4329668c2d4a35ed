"""Operator 2: bounded-space online best-fit packing of token pieces into sequences."""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memory, pieces_of, slim, texts_of, written

TOKENIZER = "word_bpe_49k.json"
SEQUENCE, END_ID = 4096, 1
#: Bins that a packer keeps open.
OPEN_BINS = 256
#: Chunks, and pairs of tokens, that a generation of a worker's memories holds, and bytes of a chunk in them.
CHUNKS_KEPT, PAIRS_KEPT, CHUNK_BYTES = 300_000, 150_000, 64
#: Signs that are words of their own after a letter.
SIGNS = b".,;:?!"
#: The tokenizer's mark of a word's end, and a byte that stands for it here (UTF-8 has no such byte).
END_OF_WORD, MARK = "</w>", b"\xff"
NEVER = 1 << 60
#: Chunks with characters from here on, whose classes may differ between Unicode's versions, go to the tokenizer itself.
SCRIPTS = "\u0530"
#: Part-filled bins of all tasks that one task of the second round packs.
TAILS_A_TASK = 50_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, tail boolean"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class Bins:
    """Open bins by free space. A bitset marks the free spaces that occur, so the tightest bin which takes
    an item is the lowest marked bit at or above the item's length, and the fullest bin the lowest of all.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.marks, self.open, self.new = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bin_ = self.by_free[free].pop()
        if not self.by_free[free]:
            self.marks ^= 1 << free
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it."""
        fits = self.marks >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            bin_, free = self.new, self.capacity
            self.new += 1
            self.open += 1
        offset, free = self.capacity - free, free - length
        if free:
            self.by_free[free].append(bin_)
            self.marks |= 1 << free
            if self.open > self.limit:
                self._take((self.marks & -self.marks).bit_length() - 1)
                self.open -= 1
        else:
            self.open -= 1
        return bin_, offset

    def rest(self) -> list[tuple[int, int]]:
        """(bin, used) of the bins still open."""
        return [(bin_, self.capacity - free) for free, bins in enumerate(self.by_free) for bin_ in bins]


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, the same as the tokenizer's.

    The tokenizer of a file of the expected kind drops white space and never merges across it, so a text's ids are those of
    its ASCII white-space separated chunks in turn, and those of short chunks are remembered. A new chunk is normalised
    and cut into words as the file says, and these are chunks of their own; a fast coder proposes a word's tokens from the ranks of
    whole tokens, and they stand if each is the tokenizer's encoding of itself and each adjacent pair that of
    the pair's bytes, which makes the list that of the word. Else, and for chunks that may hold a special token, the
    tokenizer itself encodes the chunk. Files of another kind get whole texts.

    Special tokens in a text become their ids, as the tokenizer does it by default; with ``plain`` they are text like other.
    """

    def __init__(self, path: str, plain: bool = False):
        self.path, self.plain = path, plain
        self.chunks, self.holds = Memory(self._chunk, CHUNKS_KEPT, CHUNK_BYTES), Memory(self._stands, PAIRS_KEPT)
        self.words = None
        with open(path) as file:
            model = json.load(file)
        if self._as_expected(model):
            self._prepare(model)

    @functools.cached_property
    def tokenizer(self):
        """Loaded when first needed: most texts can do without."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = self.plain
        return found

    @staticmethod
    def _as_expected(model: dict) -> bool:
        normal = [n["type"] for n in (model["normalizer"] or {}).get("normalizers", [])]
        cut = [p["type"] for p in (model["pre_tokenizer"] or {}).get("pretokenizers", [])]
        bpe = model["model"]
        plain = bpe["type"] == "BPE" and bpe["end_of_word_suffix"] == END_OF_WORD and not bpe["continuing_subword_prefix"] and not bpe["dropout"] and not bpe["ignore_merges"]
        added = all(not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] and re.fullmatch(r"\S*[^\sA-Za-z.,:;?!]\S*", t["content"]) for t in model["added_tokens"])
        return plain and added and normal == ["NFC", "Replace", "Lowercase"] and cut == ["Split", "ByteLevel"]

    def _prepare(self, model: dict) -> None:
        import regex
        import tiktoken

        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}

        def raw(token: str) -> bytes:
            ends = token.endswith(END_OF_WORD)
            return bytes(byte_of[c] for c in (token[: -len(END_OF_WORD)] if ends else token)) + MARK * ends

        bpe, ranks = model["model"], {bytes([i]): i for i in range(256)}
        ranks |= {bytes([i]) + MARK: 256 + i for i in range(256)}
        self.pairs: dict[tuple[bytes, bytes], int] = {}
        for i, merge in enumerate(bpe["merges"]):
            left, right = map(raw, merge.split(" ") if isinstance(merge, str) else merge)
            self.pairs[left, right] = i
            ranks.setdefault(left + right, 512 + i)
        ids = {raw(t): i for t, i in bpe["vocab"].items() if all(c in byte_of for c in t.removesuffix(END_OF_WORD))}
        self.raw_of = {rank: token for token, rank in ranks.items()}
        self.id_of = {rank: struct.pack("<I", ids[token]) for token, rank in ranks.items() if token in ids}
        pattern = model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.propose = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        special = [re.escape(t["content"].encode()) for t in model["added_tokens"]]
        self.special = re.compile(b"|".join(special)).search if special and not self.plain else None

    def _merged(self, data: bytes) -> list[bytes]:
        """Exact merging of the tokenizer's pairs, lowest first, the leftmost of equals."""
        ends, pairs = data.endswith(MARK), self.pairs
        parts = [data[i : i + 1] for i in range(len(data) - ends)]
        if ends:
            parts[-1] += MARK
        found = [pairs.get(pair, NEVER) for pair in zip(parts, parts[1:], strict=False)]
        while found:
            best = min(found)
            if best == NEVER:
                break
            i = found.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i:
                found[i - 1] = pairs.get((parts[i - 1], parts[i]), NEVER)
            if i < len(found):
                found[i] = pairs.get((parts[i], parts[i + 1]), NEVER)
        return parts

    def _stands(self, tokens: tuple[int, ...]) -> bool:
        """For one token or two adjacent ones."""
        parts = [self.raw_of[t] for t in tokens]
        return all(t in self.id_of for t in tokens) and self._merged(b"".join(parts)) == parts

    def _word(self, word: bytes) -> bytes:
        tokens = self.propose(word + MARK)
        if all(map(self.holds.__getitem__, zip(tokens, tokens[1:], strict=False))) if len(tokens) > 1 else self.holds[(tokens[0],)]:
            return b"".join(map(self.id_of.__getitem__, tokens))
        return self._whole(word.decode())

    def _chunk(self, chunk: bytes) -> bytes:
        """A word's ids, or those of the words that the chunk is made of: each is a chunk too."""
        chunks, signed = self.chunks, chunk[-1] in SIGNS and len(chunk) > 1
        body = chunk[:-1] if signed else chunk
        if not body.isalpha():  # other than ASCII letters
            text = body.decode()
            if not text.isascii():
                if max(text) >= SCRIPTS:
                    return self._whole(chunk.decode())
                text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")  # the tokenizer lower-cases each character alone
            text = text.lower()
            if not text.isalpha():
                if self.special and self.special(chunk):
                    return self._whole(chunk.decode())
                words = [w.encode() for w in self.words(text + chr(chunk[-1]) if signed else text)]
                return self._word(chunk) if words == [chunk] else b"".join(map(chunks.__getitem__, words))
            word = text.encode()
        else:
            word = body.lower()
        if signed:
            return chunks[word] + chunks[chunk[-1:]]
        return self._word(chunk) if word == chunk else chunks[word]

    def forget(self) -> None:
        """What a worker that may wait, or do other work, need not hold."""
        self.chunks.clear()
        self.chunks.last, self.holds.last = {}, {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        return self._whole(text) if self.words is None else b"".join(map(self.chunks.__getitem__, text.encode().split()))


@functools.cache
def encoder(path: str, plain: bool = False) -> WordEncoder:
    """One for all tasks of a Python worker."""
    return WordEncoder(path, plain)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, open_bins: int = OPEN_BINS, keep_ids: bool = False, plain: bool = False, forget: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if kept).

    A document is its ids, special tokens in the text among them unless ``plain``, and then ``end_id``; only documents longer than ``sequence`` are cut. Every task
    packs what it reads by online best-fit with ``open_bins`` open bins, the fullest closing first, and
    no text is shuffled. The bins still open when a task ends are packed once more, as blocks, together with
    those of other tasks. Null and empty texts are one piece of ``end_id`` alone; repeated rows are packed
    each; an empty table gives an empty result; other columns are ignored. With ``forget`` a worker's memory of words ends
    with its task, for jobs whose workers go on to other work.
    """
    path = tokenizer or default_tokenizer()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins, end = encoder(path, plain).encode, Bins(sequence, open_bins), np.array([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 33
        wide = 4 * sequence
        for batch in pieces_of(batches, 500):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                ids = encode(text) + end
                for piece, start in enumerate(range(0, len(ids), wide)):
                    part = ids[start : start + wide]
                    bin_, offset = bins.place(len(part) // 4)
                    rows.append((doc_id, piece, start // 4, len(part) // 4, zlib.crc32(part), first + bin_, offset, False, part))
            if rows:
                yield _batch(rows, keep_ids)
        if forget:
            encoder(path, plain).forget()
        if tails := [(None, None, None, used, None, first + bin_, None, True, b"") for bin_, used in bins.rest()]:
            yield _batch(tails, keep_ids)

    rows = slim(docs, id_col, text_col, whole=True).mapInArrow(packed, PIECES + (", ids array<int>" if keep_ids else ""))
    rows = written(rows, "pieces", 2000)
    tails = rows.where("tail").select("sequence_id", "length")
    moved = tails.repartition(max(1, -(-tails.count() // TAILS_A_TASK)), "sequence_id").sortWithinPartitions(F.desc("length"), "sequence_id")

    def repacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, homes = Bins(sequence, 16 * open_bins), {}
        for batch in batches:
            old, to, at = batch.column("sequence_id").to_pylist(), [], []
            for sequence_id, used in zip(old, batch.column("length").to_pylist(), strict=True):
                bin_, offset = bins.place(used)
                to.append(homes.setdefault(bin_, sequence_id))
                at.append(offset)
            yield pa.RecordBatch.from_arrays([pa.array(old, pa.int64()), pa.array(to, pa.int64()), pa.array(at, pa.int64())], ["sequence_id", "to", "shift"])

    moves = moved.mapInArrow(repacked, "sequence_id long, to long, shift long")
    return (
        rows.where("not tail")
        .join(moves, "sequence_id", "left")
        .select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("to", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"), *(["ids"] if keep_ids else []))
    )


def _batch(rows: list[tuple], keep_ids: bool) -> pa.RecordBatch:
    doc, piece, start, length, crc, seq, offset, tail, ids = zip(*rows, strict=True)
    long = pa.int64()
    columns = {"doc_id": pa.array(doc, long), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, long), "length": pa.array(length, long), "ids_crc32": pa.array(crc, long), "sequence_id": pa.array(seq, long), "offset": pa.array(offset, long), "tail": pa.array(tail, pa.bool_())}
    if keep_ids:
        columns["ids"] = pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32()))
    return pa.RecordBatch.from_pydict(columns)
