"""Operator 9: near-duplicate grouping by SuperMinHash signatures, banding, verification and union-find."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of, size_checked, slim, texts_of, written

#: 32 bands of 4 ranks: a pair of Jaccard similarity 0.8 shares no band once in 20 million.
BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
#: Salted groups of copies of one shingle set; at most 63.
SALTS = 32
#: Elements whose permutations a worker holds at once (a byte for each of SLOTS).
ELEMENTS = 1 << 16
#: Texts of so many documents at most are looked up by broadcasting their ids; more by a shuffled join.
BROADCAST_IDS = 500_000
WORDS_KEPT = 200_000
#: Rows with texts or sets that a Python worker gets at once.
TEXTS_AT_ONCE = 1000
#: Links that one task of union-find takes, at least: rounds between tasks are only for more.
LINKS_A_TASK = 500_000
#: Pairs with one node that a task of the verification takes; more are dealt over several.
PAIRS_A_TASK = 5000
#: Shingles of a block of a band's members, each member counting ROW_COST more.
BLOCK, ROW_COST = 400_000, 64
#: Words of 64 bits that bound the intersection of two sets; the second for sets of more than 8 shingles a word of the first.
FEW_WORDS, MANY_WORDS = 64, 1024
#: Rows that a task gathers before it compares them, pairs that it looks at together, and words of bits that it reads at once.
ROWS_AT_ONCE, PAIRS_AT_ONCE, WORDS_AT_ONCE = 2000, 1 << 18, 1 << 19

_STEP = 0x9E3779B97F4A7C15
_GOLDEN, _A, _B = np.uint64(_STEP), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """Sets of distinct shingles as sorted 64-bit hashes. Words are runs of other than ASCII white space, A-Z lower-cased."""

    def __init__(self, words: int):
        self.n, self.hashes = words, _WordHashes()

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        w = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(w))
        h = _mix(w[: len(w) - n + 1] + np.uint64(n))
        for i in range(1, n):
            h = _mix((h ^ w[i : len(w) - n + 1 + i]) * _GOLDEN + np.uint64(i))
        return np.unique(h)


def superminhash(elements: np.ndarray, owner: np.ndarray, sets: int) -> np.ndarray:
    """Signatures, sets x SLOTS, of the sets whose elements lie in ``elements`` (``owner`` says in which).

    Each element deals the slots anew by a Fisher-Yates shuffle of its own: what it deals to a slot at step j
    is j plus a fraction, and a slot keeps its least value. Steps run over all elements of all sets together;
    a set stops once no slot can improve, which is after two or three steps for sets larger than SLOTS.
    Values hold j in the upper and the fraction in the lower 32 bits.
    """
    signature = np.full(sets * SLOTS, np.iinfo(np.uint64).max, np.uint64)
    deal = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(elements), 1))
    rows, own, seeds, going = np.arange(len(elements)), owner * SLOTS, elements, np.arange(sets)
    for j in range(SLOTS):
        x = _mix(seeds + np.uint64((j + 1) * _STEP & (1 << 64) - 1))
        k = j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(SLOTS - j)) >> np.uint64(32)).astype(np.int64)
        slot = deal[rows, k]
        deal[rows, k] = deal[rows, j]
        np.minimum.at(signature, own + slot, (x >> np.uint64(32)) | np.uint64(j << 32))
        full = signature.reshape(sets, SLOTS)[going].max(1) < np.uint64((j + 1) << 32)
        if full.any():
            going = going[~full]
            if not len(going):
                break
            left = np.zeros(sets, bool)
            left[going] = True
            keep = left[own // SLOTS]
            rows, own, seeds = rows[keep], own[keep], seeds[keep]
    return signature.reshape(sets, SLOTS)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures of non-empty sets, in blocks of at most ELEMENTS elements; a larger set's blocks join by least values."""
    parts = [(i, s[at : at + ELEMENTS]) for i, s in enumerate(sets) for at in range(0, len(s), ELEMENTS)]
    out = np.full((len(sets), SLOTS), np.iinfo(np.uint64).max, np.uint64)
    while parts:
        n = size = 0
        while n < len(parts) and (not n or size + len(parts[n][1]) <= ELEMENTS):
            size += len(parts[n][1])
            n += 1
        block, parts = parts[:n], parts[n:]
        found = superminhash(np.concatenate([s for _, s in block]), np.repeat(np.arange(n), [len(s) for _, s in block]), n)
        np.minimum.at(out, [i for i, _ in block], found)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """sets x BANDS keys, different from band to band."""
    rows = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN, rows.shape[:2])
    for i in range(ROWS):
        key = _mix(key ^ rows[:, :, i]) * _A
    return key.view(np.int64)


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_id (128-bit hash of the set), salt and bands of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingles, row = Shingler(words), 0
        for batch in pieces_of(batches, 400):
            sets = [shingles(t) for t in texts_of(batch)]
            there = [s for s in sets if len(s)]
            keys = iter(band_keys(signatures(there))) if there else iter(())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("text_hash"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array(np.arange(row, row + len(sets)) % SALTS, pa.int64()),
                    pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "text_hash", "n_shingles", "set_id", "salt", "bands"],
            )
            row += len(sets)

    return hashed(docs).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_id binary, salt long, bands array<long>")


def hashed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))


def texts_at(nodes: DataFrame, places: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text): the text that stands for each node, whose row is found by id and hash of the text."""
    wanted = places.join(nodes.select("node").distinct(), "node", "left_semi").select("node", F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"))
    wanted = size_checked(wanted, BROADCAST_IDS)
    found = hashed(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")))
    return found.select("node", "text").dropDuplicates(["node"])


def verified(pairs: DataFrame, places: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose whole sets of shingles, as words, have 100 * intersection >= percent * union.

    A node in many pairs is dealt over tasks, a copy of its text to each.
    """
    texts = texts_at(pairs.select(F.explode(F.array("a", "b")).alias("node")), places, docs)
    counts = pairs.groupBy("b").agg(F.expr(f"int(ceil(count(1) / {PAIRS_A_TASK}))").alias("deals"))
    dealt = pairs.join(counts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("deals")).alias("deal"))
    right = texts.withColumnRenamed("node", "b").join(counts, "b").select("b", F.col("text").alias("text_b"), F.explode(F.expr("sequence(0L, deals - 1L)")).alias("deal"))
    both = texts.toDF("a", "text_a").join(dealt, "a").join(right, ["b", "deal"]).select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[int, set] = OrderedDict()

        def of(text: str) -> set:
            w = text.encode().lower().split()
            return set(zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else {tuple(w)}

        def kept(node: int, text: str) -> set:
            found = recent.pop(node, None)
            recent[node] = found = of(text) if found is None else found
            if len(recent) > 16:
                recent.popitem(last=False)
            return found

        for batch in pieces_of(batches, 500):
            linked = []
            for y, s, t in zip(batch.column("b").to_pylist(), texts_of(batch, "text_a"), texts_of(batch, "text_b"), strict=True):
                p, q = of(s), kept(y, t)
                common = len(p & q) if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)) else 0
                linked.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return both.mapInArrow(run, "a long, b long").distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of a task: (node, least node of its tree)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up] if up in parent else up
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [n for n in parent if root(n) != n]
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(n) for n in part], pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node of the connected component, for each node that is not the least itself.

    Each task unions its own links (LINKS_A_TASK of them) and passes on its forest; forests are then joined in rounds that connect
    each node's larger neighbours and then its smaller ones to the least (large-star, small-star), until every
    node has one parent and no parent has one. Rounds are written to the shared folder.
    """
    few = max(1, links.count() // LINKS_A_TASK)
    edges = written(links.coalesce(few).mapInArrow(_forest, "a long, b long").distinct(), "forest")
    while True:
        kids = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        chained = edges.join(kids.select(F.col("a").alias("b")), "b", "left_semi")
        if not kids.where("n > 1").select("a").limit(1).unionByName(chained.select("a").limit(1)).take(1):
            return edges.toDF("node", "component")
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = ways.join(least, "a").where("b > a").selectExpr("b as a", "m as b").where("a > b").distinct()
        large = written(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").selectExpr("b as a", "m as b").unionByName(least.selectExpr("a", "m as b"))
        edges = written(small.distinct(), "small")


class Cells:
    """Compares the rows of cells: each left one with each right one of another component. Yields links that join components.

    A pair that meets in several cells is compared in the one of the least band. Bits of both sets, each shingle's set by its hash,
    bound the intersection from above: a bit that only one set has stands for a shingle, at least, that the other lacks. Pairs
    that pass are compared shingle by shingle, unless links found before join their components already.
    """

    def __init__(self, percent: int):
        self.percent, self.parent = percent, {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    @staticmethod
    def bits(sets: list[np.ndarray], words: int) -> np.ndarray:
        """Rows of ``words`` 64-bit words."""
        out = np.zeros((len(sets), words * 8), np.uint8)
        for at in range(0, len(sets), 512):
            part = sets[at : at + 512]
            marks = np.zeros((len(part), words * 64), bool)
            marks[np.repeat(np.arange(len(part)), [len(s) for s in part]), (np.concatenate(part) & np.uint64(words * 64 - 1)).astype(np.int64)] = True
            out[at : at + 512] = np.packbits(marks, axis=1)
        return out.view(np.uint64)

    def similar(self, least: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * least >= self.percent * (a + b - least)

    def bounded(self, bits: np.ndarray, size: np.ndarray, l: np.ndarray, r: np.ndarray) -> np.ndarray:  # noqa: E741
        """Which pairs may be similar enough."""
        fine = []
        step = max(1, WORDS_AT_ONCE // bits.shape[1])
        for at in range(0, len(l), step):
            i, j = l[at : at + step], r[at : at + step]
            x, y = bits[i], bits[j]
            only_x, only_y = (np.bitwise_count(d).sum(1, dtype=np.int64) for d in (x & ~y, y & ~x))
            fine.append(self.similar(np.minimum(size[i] - only_x, size[j] - only_y), size[i], size[j]))
        return np.concatenate(fine) if fine else np.zeros(0, bool)

    def links(self, cell: np.ndarray, place: np.ndarray, node: np.ndarray, component: np.ndarray, left: np.ndarray, right: np.ndarray, bands: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """Rows are sorted by ``cell``; ``place`` is the number of the cell's band, ``bands`` has the row's keys by that number, 0 for none."""
        size = np.array([len(s) for s in sets], np.int64)
        few = self.bits(sets, FEW_WORDS)
        large = np.flatnonzero(size > FEW_WORDS * 8)
        many, at_many = self.bits([sets[i] for i in large], MANY_WORDS) if len(large) else None, np.zeros(len(sets), np.int64)
        at_many[large] = np.arange(len(large))
        rights = np.flatnonzero(right)
        start, stop = np.searchsorted(cell[rights], cell, "left"), np.searchsorted(cell[rights], cell, "right")
        lefts = np.flatnonzero(left)
        ends = np.cumsum(stop[lefts] - start[lefts])
        at = 0
        while at < len(lefts):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + PAIRS_AT_ONCE, "right")))
            own = lefts[at:to]
            n = stop[own] - start[own]
            l = np.repeat(own, n)  # noqa: E741
            r = rights[np.arange(len(l)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[own], n)]
            at = to
            good = (component[l] != component[r]) & (~left[r] | (node[l] < node[r])) & (100 * np.minimum(size[l], size[r]) >= self.percent * np.maximum(size[l], size[r]))
            l, r = l[good], r[good]  # noqa: E741
            for k in range(int(place.max(initial=0))):
                if not len(l):
                    break
                apart = (bands[l, k] != bands[r, k]) | (bands[l, k] == 0) | (k >= place[l])
                l, r = l[apart], r[apart]  # noqa: E741
            fine = self.bounded(few, size, l, r)
            l, r = l[fine], r[fine]  # noqa: E741
            if many is not None and len(l):
                both = (size[l] > FEW_WORDS * 8) & (size[r] > FEW_WORDS * 8)
                fine = ~both
                fine[both] = self.bounded(many, size[large], at_many[l[both]], at_many[r[both]])
                l, r = l[fine], r[fine]  # noqa: E741
            for i, j in zip(l.tolist(), r.tolist(), strict=True):
                x, y = self.root(int(component[i])), self.root(int(component[j]))
                if x == y:
                    continue
                both = np.concatenate((sets[i], sets[j]))
                both.sort()
                if self.similar((both[1:] == both[:-1]).sum(), size[i], size[j]):
                    self.parent[max(x, y)] = min(x, y)
                    yield int(max(node[i], node[j])), int(min(node[i], node[j]))


CELL = "band long, u int, v int, place int, node long, component long, minor boolean, asks boolean, bands array<struct<place:int, band:long>>, shingles binary"


def cells(members: DataFrame, places: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Rows of CELL: the members (band, place, node, component, main, u_blocks, v_blocks) of mixed bands with their sets.

    A band's largest component, the main one, need only meet the others; these meet all. So the others are dealt
    over ``u_blocks`` as those who ask, all members over ``v_blocks`` as those who are asked, and each pair of blocks is
    a cell of bounded size: what is copied grows with the members times the blocks of the others.
    """
    own = members.groupBy("node").agg(F.first("component").alias("component"), F.collect_list(F.struct("place", "band", "main", "u_blocks", "v_blocks")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in pieces_of(batches, 100):
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([shingles(t).tobytes() for t in texts_of(batch)], pa.binary())], ["node", "shingles"])

    sets = texts_at(members, places, docs).mapInArrow(run, "node long, shingles binary")
    rows = own.join(sets, "node").select("node", "component", "shingles", F.expr("transform(own, x -> struct(x.place as place, x.band as band))").alias("bands"), F.explode("own").alias("at"))
    rows = rows.selectExpr("*", "component <> at.main as minor", "pmod(xxhash64(node, 1), at.u_blocks) as u0", "pmod(xxhash64(node, 2), at.v_blocks) as v0")
    asking = "if(minor, transform(sequence(0L, at.v_blocks - 1L), v -> struct(u0 as u, v as v, true as asks, v = v0 as asked)), array())"
    asked = "transform(filter(sequence(0L, at.u_blocks - 1L), u -> not minor or u <> u0), u -> struct(u as u, v0 as v, false as asks, true as asked))"
    rows = rows.withColumn("cell", F.explode(F.expr(f"concat({asking}, {asked})")))
    return rows.selectExpr("at.band", "int(cell.u) as u", "int(cell.v) as v", "at.place", "node", "component", "minor", "cell.asks", "cell.asked", "bands", "shingles")


def across(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of nodes in different components, as ``Cells`` finds them in the rows of ``cells``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compare, held = Cells(percent), []

        def done(table: pa.Table, cell: np.ndarray) -> pa.RecordBatch:
            listed = table["bands"].combine_chunks()
            bands = np.zeros((table.num_rows, BANDS), np.int64)
            flat = listed.flatten()
            bands[np.repeat(np.arange(table.num_rows), np.diff(listed.offsets.to_numpy())), flat.field("place").to_numpy()] = flat.field("band").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
            node, component, place = (table[c].to_numpy() for c in ("node", "component", "place"))
            asks, asked = (table[c].to_numpy().astype(bool) for c in ("asks", "asked"))
            found = list(compare.links(cell, place, node, component, asks, asked, bands, sets))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        def numbered(table: pa.Table) -> np.ndarray:
            keys = [table[c].to_numpy() for c in ("band", "u", "v")]
            new = np.zeros(table.num_rows, bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            return np.cumsum(new)

        for batch in pieces_of(batches, ROWS_AT_ONCE):
            held.append(batch)
            if sum(b.num_rows for b in held) < ROWS_AT_ONCE:
                continue
            table = pa.Table.from_batches(held)
            cell = numbered(table)
            whole = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            if whole:
                yield done(table.slice(0, whole), cell[:whole])
                held = table.slice(whole).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            if table.num_rows:
                yield done(table, numbered(table))

    return rows.repartition("band", "u", "v").sortWithinPartitions("band", "u", "v").mapInArrow(run, "a long, b long").distinct()


def _grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (a number of the group, null without shingles) and component_id of each document."""
    sketches = written(sketch(docs, words), "sketches", TEXTS_AT_ONCE)
    some = sketches.where("n_shingles > 0")
    classes = (
        some.groupBy("set_id", "salt").agg(F.min("doc_id").alias("doc_id"))
        .groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.bit_or(F.expr("shiftleft(1L, cast(salt as int))")).alias("salts"))
    )
    key = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key")
    first = classes.select("set_id", key, "salts")
    reps = some.select("set_id", key, "doc_id", "text_hash", "n_shingles", "bands").join(first, ["set_id", "key"]).dropDuplicates(["set_id", "key"])
    reps = written(reps.drop("key").withColumn("node", F.monotonically_increasing_id()), "classes")
    places = reps.select("node", "doc_id", "text_hash")
    bands = reps.select("node", "n_shingles", F.posexplode("bands").alias("place", "band"))
    hubs = bands.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = written(bands.join(hubs, "band"), "shared")
    stars = shared.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    links = written(verified(stars, places, docs, words, percent), "links", TEXTS_AT_ONCE)
    found = components(links)

    placed = shared.drop("hub").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = placed.groupBy("band", "component").agg(F.sum(F.col("n_shingles") + ROW_COST).alias("size"))
    mixed = parts.groupBy("band").agg(F.max_by("component", "size").alias("main"), F.sum("size").alias("total"), F.max("size").alias("most")).where("total > most")
    mixed = mixed.selectExpr("band", "main", f"ceil((total - most) / {BLOCK}) as u_blocks", f"ceil(total / {BLOCK}) as v_blocks")
    members = written(placed.join(mixed, "band"), "members")
    more = written(across(cells(members, places, docs, words), percent), "more", TEXTS_AT_ONCE)
    if more.take(1):
        links = written(links.unionByName(verified(more, places, docs, words, percent)), "all_links", TEXTS_AT_ONCE)
        found = components(links)

    groups = reps.select("node", "set_id", "doc_id", "salts").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = groups.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    salts = F.explode(F.expr(f"filter(sequence(0L, {SALTS - 1}L), s -> (shiftright(salts, cast(s as int)) & 1L) = 1L)")).alias("salt")
    groups = groups.join(least, "component").select("set_id", F.col("component").alias("node"), "component_id", salts)
    placed_docs = sketches.select("doc_id", "text_hash", "n_shingles", "set_id", "salt").join(groups, ["set_id", "salt"], "left")
    return placed_docs.select("doc_id", "text_hash", "n_shingles", "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when the Jaccard similarity of their sets of ``words``-word shingles is at least
    ``percent`` %; component_id is the smallest id reachable over links. A text of fewer words is one shingle;
    texts without a word, and null ones, have no shingle and no link. Equal sets (by a 128-bit hash) are one class from
    the start. Classes that share a band are compared with one of the band; links are confirmed on whole sets of words and
    joined by union-find. Then the members of bands that still hold two components or more are compared across
    components, in cells of bounded size (see ``cells``), so that no link is lost to the choice of the one; pairs within a
    component need no comparison, and only links leave a cell.

    Ids are integers. An empty table gives an empty result. A null id is a row like others: its group has the smallest id
    there is in it, null if none. Rows repeated with an id get an answer each, by their own texts. Other columns are ignored.
    """
    found = _grouped(slim(docs, id_col, text_col, whole=True), words, percent)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, one of each group: of the smallest id, and of that id's texts in the group the one with the
    least hash. Rows without a word stay, each. Of rows repeated with id and text an arbitrary one stays."""
    found = _grouped(slim(docs, id_col, text_col, whole=True), words, percent).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = found.where("node is not null").groupBy("node", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    chosen = chosen.groupBy("node").agg(F.min("doc_id").alias("of_id"), F.min("text_hash").alias("of_hash"), F.sum("n").alias("n"))
    empty = found.where("node is null").select("node", F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), F.lit(1).alias("n"))
    chosen = written(chosen.unionByName(empty), "chosen")

    def of(keys: DataFrame) -> DataFrame:
        return docs.join(keys, docs[id_col].eqNullSafe(keys["of_id"]) & (F.xxhash64(docs[text_col]) == keys["of_hash"]), "left_semi")

    if not chosen.where("n > 1").take(1):
        return of(chosen)
    own = [F.col(c) for c in docs.columns]
    again = of(chosen.where("n > 1")).groupBy(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__hash")).agg(F.first(F.struct(*own)).alias("__row"))
    return of(chosen.where("n = 1")).unionByName(again.select("__row.*"))


def sql(words: int = 4, percent: int = 80) -> str:
    """DuckDB SQL of the result; it joins shingles of all documents, so it suits small tables."""
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return f"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [list_aggregate(w, 'string_agg', ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - {words} + 2), lambda i: {gram})) END AS s
  FROM split
), classes AS (
  SELECT min(doc_id) AS rep, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)
), grams AS (
  SELECT rep, unnest(s) AS g FROM classes
), rare AS (
  SELECT rep, g FROM grams QUALIFY count(*) OVER (PARTITION BY g) > 1
), common AS (
  SELECT a.rep AS a, b.rep AS b, count(*) AS n FROM rare a JOIN rare b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN classes x ON x.rep = a JOIN classes y ON y.rep = b WHERE 100 * n >= {percent} * (len(x.s) + len(y.s) - n)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT rep AS a, rep AS b FROM classes UNION SELECT r.a, w.b FROM reach r JOIN ways w ON w.a = r.b
), lowest AS (
  SELECT a AS rep, min(b) AS component FROM reach GROUP BY a
)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept
FROM sets LEFT JOIN classes ON len(sets.s) > 0 AND list_sort(sets.s) = classes.s LEFT JOIN lowest USING (rep)
"""
