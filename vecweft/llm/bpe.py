"""Operator 8: byte-level BPE encoding and decoding by monoid tree reduction."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memory, pieces_of, slim, texts_of

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes up to which a leaf of the tree is merged directly.
LEAF = 8
#: Matches, leaves and pairs of tokens that a generation of a worker's memories holds, and characters of a match in them.
KEPT, LEAVES_KEPT, PAIRS_KEPT, MATCH = 700_000, 100_000, 200_000, 64
#: Bytes of a window that is merged without a queue, and tokens of a leaf when decoding.
DIRECT, RUN = 64, 64
NEVER = 1 << 60


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class TreeCoder:
    """Encodes byte strings by merging pairs of lowest rank, as a reduction over an associative join.

    A string's element is its token list. The join of two neighbours rests on this: a list of tokens is the
    encoding of its bytes if and only if each adjacent pair is the encoding of that pair's bytes. (The first
    merge that crosses a border between two tokens would, up to then, have seen inside this pair just what it
    sees when the pair stands alone.) So tokens outside a re-encoded window are final once the two pairs at
    the window's edges are encodings of themselves; until then the window grows on the side that is not.
    Leaves, and the encodings of pairs, come again and again and are remembered.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=0) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.leaves = Memory(self.merged, LEAVES_KEPT)
        self.pairs = Memory(lambda pair: self.merged(self.tokens[pair[0]] + self.tokens[pair[1]]), PAIRS_KEPT)

    def merged(self, data: bytes) -> list[int]:
        """Direct merging, for leaves and windows: always the lowest rank, the leftmost of equals."""
        ranks = self.ranks
        if len(data) > DIRECT:
            return self.queued(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        found = [ranks.get(data[i : i + 2], NEVER) for i in range(len(data) - 1)]
        while found:
            best = min(found)
            if best == NEVER:
                break
            i = found.index(best)
            parts[i : i + 2] = [self.tokens[best]]
            del found[i]
            if i:
                found[i - 1] = ranks.get(parts[i - 1] + parts[i], NEVER)
            if i < len(found):
                found[i] = ranks.get(parts[i] + parts[i + 1], NEVER)
        return [ranks[p] for p in parts]

    def queued(self, data: bytes) -> list[int]:
        """The same by a queue of pairs over a linked list, for long windows."""
        ranks, n = self.ranks, len(data)
        part: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i, size = heapq.heappop(queue)
            j = after[i] if part[i] is not None else n
            if j >= n or len(part[i]) + len(part[j]) != size or self.tokens[rank] != part[i] + part[j]:
                continue  # one of the two has been merged meanwhile
            part[i], part[j] = self.tokens[rank], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n and (r := ranks.get(part[left] + part[right])) is not None:
                    heapq.heappush(queue, (r, left, len(part[left]) + len(part[right])))
        return [ranks[p] for p in part if p is not None]

    def holds(self, left: int, right: int) -> bool:
        return self.pairs[left, right] == [left, right]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        window = self.pairs[left[-1], right[0]]
        if len(window) == 2 and window[0] == left[-1]:
            return left + right
        i = j = 1
        while True:
            at_left = i == len(left) or self.holds(left[-i - 1], window[0])
            at_right = j == len(right) or self.holds(window[-1], right[j])
            if at_left and at_right:
                return left[:-i] + window + right[j:]
            if not at_left:
                i = min(len(left), 2 * i)
            if not at_right:
                j = min(len(right), 2 * j)
            window = self.merged(b"".join(map(self.tokens.__getitem__, left[-i:] + right[:j])))

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.leaves[data]
        half = 1 << (len(data) - 1).bit_length() - 1  # halves at powers of two, so that long runs of a character line up
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def encode(self, data: bytes) -> list[int]:
        """As a rank file's users encode one match of the pattern: a match that is a token is that token."""
        rank = self.ranks.get(data)
        return self.tree(data) if rank is None else [rank]

    def decode(self, ids: list[int]) -> bytes:
        """Up the tree: leaves of RUN tokens, then two neighbours at a time."""
        if len(ids) <= RUN:
            return b"".join(map(self.tokens.__getitem__, ids))
        return up_the_tree([b"".join(map(self.tokens.__getitem__, ids[at : at + RUN])) for at in range(0, len(ids), RUN)])


def up_the_tree(parts: list[bytes]) -> bytes:
    """Decoding is a homomorphism: the bytes of neighbours are concatenated, two at a time."""
    while len(parts) > 1:
        parts = [b"".join(parts[at : at + 2]) for at in range(0, len(parts), 2)]
    return parts[0] if parts else b""


class TextCoder:
    """Encodes texts match by match, and remembers what ``outputs`` need of short matches: (ids, ids in decimal, bytes of the ids)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, outputs: tuple[str, ...] = ("ids",)):
        import regex

        self.coder, self.outputs = TreeCoder(ranks), outputs
        self.known = Memory(self._leaf, KEPT, MATCH)
        self.decimal = [str(i) for i in range(len(self.coder.tokens))]
        self.wants = "ids" in outputs, "ids_sha256" in outputs, bool({"decoded", "decoded_sha256"} & set(outputs))
        # White space is Unicode's property; by default this library counts four control characters too.
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall

    def _leaf(self, match: str) -> tuple:
        ids = self.coder.encode(match.encode())
        whole, decimal, decoded = self.wants
        return len(ids), ids if whole else None, ",".join(map(self.decimal.__getitem__, ids)) if decimal else None, self.coder.decode(ids) if decoded else None

    def leaves(self, text: str) -> tuple:
        """(numbers of tokens, ids, decimals, bytes) of the matches in turn."""
        return tuple(zip(*map(self.known.__getitem__, self.find(text)), strict=True)) or ((), (), (), ())

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.leaves(text)[1]))

    def outcome(self, text: str) -> tuple:
        """n_tokens and the outputs."""
        n, ids, decimals, data = self.leaves(text)
        found = [sum(n)]
        decoded = up_the_tree([b"".join(data[at : at + RUN]) for at in range(0, len(data), RUN)]) if self.wants[2] else b""
        for output in self.outputs:
            if output == "ids":
                found.append(list(chain.from_iterable(ids)))
            elif output == "decoded":
                found.append(decoded)
            else:
                found.append(hashlib.sha256(",".join(decimals).encode() if output == "ids_sha256" else decoded).hexdigest())
        return tuple(found)


@functools.cache
def text_coder(path: str, pattern: str, outputs: tuple[str, ...] = ("ids",)) -> TextCoder:
    """One for all tasks of a Python worker."""
    return TextCoder(load_ranks(path), pattern, outputs)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None, outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """doc_id, n_tokens and the chosen outputs of each whole text, without special tokens.

    Outputs are ``ids`` (array<int>), ``decoded`` (binary, from the ids), ``ids_sha256`` (of the decimal ids
    joined by commas) and ``decoded_sha256``. Null counts as empty: no tokens, digests of nothing. Rows go
    one by one, whatever repeats; an empty table gives an empty result; other columns are ignored.
    """
    path, cut = ranks or default_ranks(), pattern or default_pattern()
    kinds = {"ids": pa.list_(pa.int32()), "decoded": pa.binary(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    schema = ", ".join(["doc_id long", "n_tokens long", *(f"{o} {'array<int>' if o == 'ids' else 'binary' if o == 'decoded' else 'string'}" for o in outputs)])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outcome = text_coder(path, cut, outputs).outcome
        for batch in pieces_of(batches, 250):
            found = list(zip(*map(outcome, texts_of(batch)), strict=True)) or [()] * (1 + len(outputs))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found[0], pa.int64()), *(pa.array(v, kinds[o]) for o, v in zip(outputs, found[1:], strict=True))], ["doc_id", "n_tokens", *outputs])

    return slim(docs, id_col, text_col, whole=True).mapInArrow(coded, schema)


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id and decoded (binary) of rows with doc_id and ids; null ids decode to nothing."""
    path = ranks or default_ranks()

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_coder(path, default_pattern()).coder
        for batch in pieces_of(batches, 250):
            texts = [coder.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(back, "doc_id long, decoded binary")


def round_trip(docs: DataFrame) -> DataFrame:
    """The digests that the query returns."""
    return encode(docs, outputs=("ids_sha256", "decoded_sha256"))
