"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search,
then exact weighted-shingle similarity.

Texts become words (runs of letters and digits, case of A-Z ignored) and shingles of
``K`` words (a shorter text is one shingle). For each benchmark item, documents are read
in windows of the item's number of words, at every word. The SimHash of a window
adds +1 or -1 per bit and shingle, so repeated shingles weigh more, and prefix sums give
all windows of a size. A multi-index table finds every item of that size whose
fingerprint lies within ``RADIUS`` bits: 64 bits are ``BLOCKS`` blocks, and some block of a
pair within the radius differs in at most ``RADIUS // BLOCKS`` bits, so each item is listed
under all values that near in each block, in tables by the items' size. Candidates match if their weighted Jaccard
similarity (sum of minima over sum of maxima of shingle counts) is at least
``THRESHOLD``.

A document with fewer words than an item is one window, its whole text, for the items of
which it has at least ``THRESHOLD`` of the shingles (no others can reach that similarity).

A window that shares no shingle with any item of its size has similarity 0 to them, so only windows
around a shared shingle of such an item are fingerprinted. Items go to the tasks in blocks of about
``ITEM_BLOCK`` (the benchmark is the stated query set, documents are never collected).

Pairs at the threshold are about 10 bits apart (standard deviation 3), so pairs beyond the
radius, the method's only loss, are very rare (measured in the README).

Rows: null and empty texts match nothing; items without words match nothing; documents
without id, or with repeated ids, are matched row by row; of windows that tie, the first.
An item id with several texts is one item: its best window over all of them counts.
Items without id match like others and are reported, each different text by itself, with a
null item_id; one whose text an item with id has too is that item.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crmlake.llm import textvec as tv
from crmlake.llm.common import documents

K = 5
THRESHOLD = 0.8
RADIUS = 23
BLOCKS = 8
ITEM_BLOCK = 20_000        # items that a task holds (about 2 kB each); documents are read once per block
SEGMENT = 4_096            # window starts fingerprinted at once
MATCH_SCHEMA = "doc_id long, item_id long, similarity double, start int, end int"
WORD = tv.alnum_words()
BIT = np.arange(64, dtype=np.uint64)
_indexes: dict[bytes, Index] = {}


def near_values(bits: int, radius: int) -> np.ndarray:
    """All masks of ``bits`` bits with at most ``radius`` ones."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)], np.int64)


def signed_bits(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 per bit of each shingle's hash."""
    return (((shingles[:, None] >> BIT) & np.uint64(1)).astype(np.int32) << 1) - 1


def pack(sums: np.ndarray) -> np.ndarray:
    """Fingerprints: a bit is set where its sum isn't negative."""
    return ((sums >= 0).astype(np.uint64) << BIT).sum(axis=1, dtype=np.uint64)


def simhash(shingles: np.ndarray) -> np.uint64:
    return pack(signed_bits(shingles).sum(axis=0, keepdims=True))[0]


class Index:
    """Items of a block: shingle counts, and items by size and near values of each block of bits."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        self.items, prints = [], []
        for item, text in items:
            buf = np.frombuffer(text, np.uint8)
            words = tv.words(buf, np.array([0, len(buf)]), WORD)[2]
            if len(words):
                own = tv.shingles(words, k := min(K, len(words)))
                self.items.append((item, k, len(own), *np.unique(own, return_counts=True)))
                prints.append(simhash(own))
        self.prints = np.array(prints, np.uint64)
        self.shape = np.array([(k, n) for _, k, n, _, _ in self.items], np.int64).reshape(-1, 2)
        # per k: the items' shingles, and for each the sizes of the items that hold it
        self.known = {}
        for k in set(self.shape[:, 0].tolist()):
            own = [i for i in self.items if i[1] == k]
            pairs = np.unique(np.rec.fromarrays([np.concatenate([i[3] for i in own]), np.repeat([i[2] for i in own], [len(i[3]) for i in own])]))
            values, first = np.unique(pairs.f0, return_index=True)
            self.known[k] = values, np.r_[first, len(pairs)], pairs.f1.astype(np.int64)
        width = 64 // BLOCKS
        masks = near_values(width, RADIUS // BLOCKS)
        self.tables = {}
        for k, n in set(map(tuple, self.shape.tolist())):
            own = np.flatnonzero((self.shape[:, 0] == k) & (self.shape[:, 1] == n))
            self.tables[k, n] = tables = []
            for b in range(BLOCKS):
                value = ((self.prints[own] >> np.uint64(b * width)) & np.uint64((1 << width) - 1)).astype(np.int64)
                near = (value[:, None] ^ masks).ravel()
                order = np.argsort(near, kind="stable")
                owner = np.repeat(own.astype(np.int32), len(masks))[order]
                tables.append((np.searchsorted(near[order], np.arange((1 << width) + 1)).astype(np.int32), owner))

    @staticmethod
    def of(items: list[tuple[int | None, bytes]], key: bytes) -> Index:
        if key not in _indexes:
            _indexes.clear()
            _indexes[key] = Index(items)
        return _indexes[key]

    def candidates(self, prints: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within RADIUS whose item has the windows' size."""
        width, found = 64 // BLOCKS, [np.zeros(0, np.int64)]
        for b, (start, owner) in enumerate(self.tables.get((k, n), [])):
            value = ((prints >> np.uint64(b * width)) & np.uint64((1 << width) - 1)).astype(np.int64)
            lo, count = start[value].astype(np.int64), start[value + 1] - start[value]
            window = np.repeat(np.arange(len(prints)), count)
            at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + lo[window]
            item = owner[at].astype(np.int64)
            close = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
            found.append(window[close] * len(self.items) + item[close])
        return np.divmod(np.unique(np.concatenate(found)), max(len(self.items), 1))

    def similarity(self, window: np.ndarray, item: int) -> float:
        _, _, n, own, counts = self.items[item]
        values, times = np.unique(window, return_counts=True)
        at = np.minimum(np.searchsorted(own, values), len(own) - 1)
        both = int(np.minimum(times, counts[at])[own[at] == values].sum())
        return both / (n + len(window) - both)

    def matches(self, words: np.ndarray) -> dict[int | tuple[int], tuple[float, int, int]]:
        """Best (similarity, first word, words) per item for one document's word hashes; items
        are their ids, those without id a tuple of their position."""
        best: dict[int | tuple[int], tuple[float, int, int]] = {}
        for k, (known, first, sizes) in self.known.items():
            shingles = tv.shingles(words, k) if len(words) >= k else words[:0]
            at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
            hits = np.flatnonzero(known[at] == shingles)
            if len(hits):
                # each hit counts for the sizes of the items that hold its shingle
                lo, count = first[at[hits]], first[at[hits] + 1] - first[at[hits]]
                size = sizes[np.arange(int(count.sum())) + np.repeat(lo - (np.cumsum(count) - count), count)]
                place = np.repeat(hits, count)
                for n in np.unique(size).tolist():
                    if n <= len(shingles):
                        self._windows(shingles, place[size == n], k, n, best)
                    elif len(shingles) >= THRESHOLD * n - 1e-9:
                        self._verify(shingles, np.zeros(1, np.int64), simhash(shingles)[None], k, n, best)
        return best

    def _verify(self, shingles, starts, prints, k, n, best) -> None:
        """Best matches among the items of n shingles for the windows at ``starts``."""
        window, item = self.candidates(prints, k, n)
        size = min(n, len(shingles))
        for w, i in zip(starts[window].tolist(), item.tolist(), strict=True):
            s = self.similarity(shingles[w:w + size], i)
            name = self.items[i][0] if self.items[i][0] is not None else (i,)
            if s >= THRESHOLD and (name not in best or s > best[name][0]):
                best[name] = (s, w, size + k - 1)

    def _windows(self, shingles, hits, k, n, best) -> None:
        last = len(shingles) - n
        near = np.zeros(last + 2, np.int64)
        np.add.at(near, np.minimum(np.maximum(hits - n + 1, 0), last + 1), 1)
        np.add.at(near, np.minimum(hits + 1, last + 1), -1)
        starts = np.flatnonzero(np.cumsum(near[:-1]) > 0)
        lo = 0
        while lo < len(starts):
            hi = int(np.searchsorted(starts, starts[lo] + SEGMENT))
            part, base = starts[lo:hi], starts[lo]
            total = np.zeros((part[-1] + n - base + 1, 64), np.int32)
            np.cumsum(signed_bits(shingles[base:part[-1] + n]), axis=0, out=total[1:])
            self._verify(shingles, part, pack(total[part - base + n] - total[part - base]), k, n, best)
            lo = hi


def matched_chunks(batches: Iterator[pa.RecordBatch], shared, text_col: str):
    """(rows, word starts, word ends, offsets, [(row, first word, item, (similarity, first, words))])."""
    key, items = shared.value
    index = Index.of(items, key)
    for rows, buf, offsets in tv.chunks(batches, text_col):
        starts, ends, hashes, doc = tv.words(buf, offsets, WORD)
        cut = np.searchsorted(doc, np.arange(len(offsets)))
        found = [(i, cut[i], None if isinstance(item, tuple) else item, m) for i in range(len(offsets) - 1)
                 for item, m in sorted(index.matches(hashes[cut[i]:cut[i + 1]]).items(), key=lambda x: (isinstance(x[0], tuple), x[0]))]
        yield rows, starts, ends, offsets, found


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """Blocks of about ITEM_BLOCK items: a key and [(id, text)]."""
    own = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL").distinct()
    named = own.where("id IS NOT NULL")
    own = named.unionByName(own.where("id IS NULL").join(named.select("text").distinct(), "text", "left_anti"))
    blocks = -(-own.count() // ITEM_BLOCK)
    # all texts of an id fall in one block
    key = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.col("text")))
    for b in range(blocks):
        rows = own.where(F.pmod(key, F.lit(blocks)) == b).collect()
        block = sorted(((r[0], r[1].encode()) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield b"%d/%d %d" % (b, blocks, hash(tuple(block))), block


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, start and end (bytes of the text) of the best window of each pair that matches."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = spark.createDataFrame([], MATCH_SCHEMA)

    def matches(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, starts, ends, offsets, found in matched_chunks(batches, shared, "text"):
                row = np.array([f[0] for f in found], np.int64)
                first = np.array([f[1] + f[3][1] for f in found], np.int64)
                size = np.array([f[3][2] for f in found], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(pa.array(row)), pa.array([f[2] for f in found], pa.int64()),
                     pa.array([f[3][0] for f in found], pa.float64()), pa.array(starts[first] - offsets[row], pa.int32()),
                     pa.array(ends[first + size - 1] - offsets[row], pa.int32())],
                    names=["doc_id", "item_id", "similarity", "start", "end"])
        return run
    for block in item_blocks(items):
        out = out.unionByName(texts.mapInArrow(matches(spark.sparkContext.broadcast(block)), MATCH_SCHEMA))
    return out


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item matches, all columns."""
    def clean(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, *_, found in matched_chunks(batches, shared, text_col):
                keep = np.ones(rows.num_rows, bool)
                keep[[f[0] for f in found]] = False
                yield rows.filter(pa.array(keep))
        return run
    for block in item_blocks(items):
        docs = docs.mapInArrow(clean(docs.sparkSession.sparkContext.broadcast(block)), docs.schema)
    return docs


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
