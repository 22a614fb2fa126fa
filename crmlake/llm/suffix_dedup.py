"""Substring deduplication: remove every byte covered by a ``LENGTH``-byte string that
also starts anywhere else (all documents, the same one included).

Prefix doubling sorts the pairs (rank of a position, rank of the position an offset
further on) and re-ranks until a position is unique or the offset passes the
threshold. Over every byte position that moves dozens of times the input, so the
first round ranks a content-defined sample and only what stays repeated goes on:

1. Rank at 64 bytes. In every ``LENGTH``-byte string one position is its anchor: the
   64-byte prefix with the smallest hash (the leftmost of equals). Equal strings have
   equal anchors at the same place, so each anchor speaks for the run of starts that
   it owns. Its rank pair is (hash of its 64 bytes, hash of the whole region its run of
   strings covers). Spark sorts the pairs; neighbours in that order re-rank them:
   a unique first rank ends a run (nothing in it repeats), an equal pair proves the
   whole run repeated, and only runs between the two stay open.
2. The regions of open runs, and one region of each different pair they sort next to, go on
   by their first rank. Each start doubles from 64 to 128 bytes (pair at offset 64) and to
   ``LENGTH`` bytes (pair at the rest); starts whose last rank is not unique repeat.
   First ranks with over ``HOT`` different regions are ranked by Spark again, on
   the last rank itself, so that no task holds such a group.
3. Repeated starts come back to their document, whose covered bytes are cut.

Ranks are 64-bit fingerprints; two of them have to agree for a match (first rank and region
rank, or first and last rank). Copies inside a chunk of a task are combined before the
first shuffle.

Rows: null text is empty; texts shorter than ``LENGTH`` bytes stay whole; rows with the
same id, or without one, are told apart by 128 bits of hashes of the text; rows that
repeat id and text are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crmlake.llm import textvec as tv
from crmlake.llm.common import documents, written

LENGTH = 200
FIRST = 64
SEGMENT = 1 << 19          # starts handled at once
HOT = 20_000
RANK_SCHEMA = "h long, c long, doc_id long, t1 long, t2 long, s int, n_starts int, many boolean"
RUN_SCHEMA = "doc_id long, t1 long, t2 long, lo int, hi int"
KEY_SCHEMA = "h long, key long, doc_id long, t1 long, t2 long, s int, open boolean"
ROW = ["doc_id", "t1", "t2"]     # tells rows apart: the id and 128 bits of the text
THERE = {c: f"__{c}" for c in ROW}
U64 = np.uint64


def grams(total: np.ndarray, inverse: np.ndarray, starts: np.ndarray, length) -> np.ndarray:
    """Fingerprints of bytes [start, start + length) from prefix sums."""
    return tv.mix((total[starts + length] - total[starts]) * inverse[starts])


def prefix_sums(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, inverse = tv.powers()
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * p[:len(buf)], out=total[1:])
    return total, inverse


def anchored_runs(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, first: int = FIRST) -> tuple[np.ndarray, ...]:
    """(start, number of starts, first rank, region rank) of each anchor's run, in a chunk.

    A run never crosses a document border or a segment border; the cut ones stay open
    and are settled by their starts."""
    out = []
    window = length - first + 1
    for a in range(0, len(buf) - length + 1, SEGMENT):
        part = buf[a:a + SEGMENT + length - 1]
        total, inverse = prefix_sums(part)
        n = len(part) - first + 1
        rank = tv.mix((total[first:] - total[:n]) * inverse[:n])
        low = ((rank >> U64(22)) << U64(22)) | np.arange(n, dtype=U64)
        span = 1
        while 2 * span <= window:
            low, span = np.minimum(low[:-span], low[span:]), 2 * span
        if span < window:
            low = np.minimum(low[:len(low) - (window - span)], low[window - span:])
        anchor = (low & U64((1 << 22) - 1)).astype(np.int64)
        ends = offsets[1:][np.searchsorted(offsets, np.arange(a, a + len(anchor)), "right") - 1]
        starts = np.flatnonzero(np.arange(a, a + len(anchor)) + length <= ends)
        if not len(starts):
            continue
        anchor = anchor[starts]
        new = np.flatnonzero(np.r_[True, (np.diff(anchor) != 0) | (np.diff(starts) != 1)])
        s, count = starts[new], np.diff(np.r_[new, len(starts)])
        shape = ((anchor[new] - s) * 1024 + count).astype(U64)
        region = tv.mix(grams(total, inverse, s, count - 1 + length) + shape * U64(tv.BASE))
        out.append((s + a, count, rank[anchor[new]], region))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, U64, U64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def rank_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rank pairs of anchors. Equal pairs of a chunk go on once, marked ``many``; the
    others of them are settled already: they come with a null region and a first rank
    of their own, which spreads them over the partitions."""
    for rows, buf, offsets in tv.chunks(batches, "text"):
        s, count, h, c = anchored_runs(buf, offsets)
        if not len(s):
            continue
        _, first, back, copies = np.unique(tv.mix(h * U64(tv.BASE) + c), return_index=True, return_inverse=True, return_counts=True)
        lead = np.zeros(len(s), bool)
        lead[first] = True
        doc = np.searchsorted(offsets, s, "right") - 1
        take = pa.array(doc)
        h = np.where(lead, h, tv.mix(h + s.astype(U64) * U64(tv.BASE) + U64(len(buf))))
        ranks = [pa.array(h.view(np.int64)), pa.array(c.view(np.int64), mask=~lead)]
        yield pa.RecordBatch.from_arrays(
            [*ranks, *(rows.column(c).take(take) for c in ROW), pa.array(s - offsets[doc], pa.int32()),
             pa.array(count, pa.int32()), pa.array(copies[back] > 1)],
            names=["h", "c", *ROW, "s", "n_starts", "many"])


def last_ranks(regions: pa.Array, counts: np.ndarray, length: int = LENGTH, first: int = FIRST) -> tuple[np.ndarray, np.ndarray]:
    """(row, rank at ``length`` bytes) of every start of every region, by doubling."""
    buf, offsets = tv.text_buffer(regions)
    row = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offsets[:-1], counts)
    out = np.empty(len(row), U64)
    lo = 0
    while lo < len(row):                       # pieces whose bytes fit the power table
        base = start[lo]
        hi = int(np.searchsorted(start, base + tv.PIECE - length, "right"))
        total, inverse = prefix_sums(buf[base:start[hi - 1] + length])
        at = start[lo:hi] - base
        rank, known = {}, first

        def at_first(shift, total=total, inverse=inverse, at=at):
            return grams(total, inverse, at + shift, first)
        rank = at_first
        while known < length:                  # rank pairs at growing offsets
            step = min(known, length - known)

            def pair(shift, rank=rank, step=step):
                return tv.mix(rank(shift) * U64(tv.BASE) + rank(shift + step))
            rank, known = pair, known + step
        out[lo:hi] = rank(0)
        lo = hi
    return row, out


def repeated(h: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Whether another start has both ranks: the first (``h``, in order) and the last."""
    order = np.lexsort((rank, h))
    same = (h[order][1:] == h[order][:-1]) & (rank[order][1:] == rank[order][:-1])
    out = np.zeros(len(rank), bool)
    out[order] = np.r_[same, False][:len(rank)] | np.r_[False, same][:len(rank)]
    return out


def _runs(row: np.ndarray, start: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of kept starts: (row, first, last)."""
    row, start = row[keep], start[keep]
    if not len(row):
        return row, start, start
    new = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(start) != 1)])
    return row[new], start[new], start[np.r_[new[1:] - 1, len(row) - 1]]


def settle_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated starts of open runs. Rows come sorted by first rank; a group is kept until
    the next one begins, and has HOT rows at most."""
    def settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, s = (batch.column(c).to_numpy() for c in ("n_starts", "s"))
        h = batch.column("h").to_numpy().view(U64)
        row, rank = last_ranks(batch.column("region"), counts)
        start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + s[row]
        opened = batch.column("open").to_numpy(zero_copy_only=False)
        r, lo, hi = _runs(row, start, repeated(h[row], rank) & opened[row])
        take = pa.array(r)
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ROW), pa.array(lo, pa.int32()),
                                           pa.array(hi, pa.int32())], names=[*ROW, "lo", "hi"])
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            held.append(batch.slice(lo, 2000))
            h = held[-1].column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))       # the last group may go on
            if cut == 0 and all(b.column("h")[0].as_py() == h[-1] for b in held):
                continue
            done = pa.Table.from_batches([*held[:-1], held[-1].slice(0, cut)]).combine_chunks().to_batches()
            held = [held[-1].slice(cut)]
            for b in done:
                if b.num_rows:
                    yield settle(b)
    if held and sum(b.num_rows for b in held):
        for b in pa.Table.from_batches(held).combine_chunks().to_batches():
            yield settle(b)


def key_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last rank of every start, one row each (only for first ranks with many regions)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            counts, s = (part.column(c).to_numpy() for c in ("n_starts", "s"))
            row, rank = last_ranks(part.column("region"), counts)
            start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + s[row]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [part.column("h").take(take), pa.array(rank.view(np.int64)), *(part.column(c).take(take) for c in ROW),
                 pa.array(start, pa.int32()), part.column("open").take(take)], names=["h", "key", *ROW, "s", "open"])


def cut_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the covered bytes of every document."""
    for rows, buf, offsets in tv.chunks(batches, "text"):
        kept, removed, spans = [], [], []
        for i, runs in enumerate(rows.column("runs")):
            text = buf[offsets[i]:offsets[i + 1]]
            edge = np.zeros(len(text) + 1, np.int64)
            if runs.is_valid and len(runs):
                lo, hi = (runs.values.field(f).to_numpy() for f in ("lo", "hi"))
                np.add.at(edge, lo, 1)
                np.add.at(edge, hi + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept.append(text[~gone].tobytes())
            removed.append(int(gone.sum()))
            spans.append(int((gone & ~np.r_[False, gone[:-1]]).sum()))
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
             pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def same_row(here: DataFrame, there: DataFrame):
    return (here["doc_id"].eqNullSafe(there[THERE["doc_id"]]) & (here["t1"] == there[THERE["t1"]]) & (here["t2"] == there[THERE["t2"]]))


def repeated_starts(texts: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, lo, hi): runs of starts whose string also starts elsewhere."""
    by = Window.partitionBy("h").orderBy("c")
    ranked = texts.mapInArrow(rank_pass, RANK_SCHEMA)
    before, after = F.lag("c").over(by), F.lead("c").over(by)
    pairs = (ranked.withColumns({"before": before, "after": after})
             .where("many OR before IS NOT NULL OR after IS NOT NULL")
             .withColumn("full", F.col("many") | F.coalesce(F.col("c") == F.col("before"), F.lit(False))
                         | F.coalesce(F.col("c") == F.col("after"), F.lit(False)))
             .withColumn("lead", F.coalesce(F.col("c") != F.col("before"), F.lit(True))))
    group = Window.partitionBy("h")
    pairs = (pairs.withColumn("n_open", F.sum((~F.col("full")).cast("int")).over(group))
             .withColumn("regions", F.sum(F.col("lead").cast("int")).over(group))
             .select(F.when(F.col("lead") & (F.col("n_open") > 0), F.col("h")).alias("h"), *ROW, "s", "n_starts", "full", "regions"))
    pairs = written(pairs.where("full OR h IS NOT NULL"), "suffix-pairs")
    asked = pairs.where("h IS NOT NULL").withColumnsRenamed(THERE)
    region = F.substring(F.col("text").cast("binary"), F.col("s") + 1, F.col("n_starts") + LENGTH - 1).alias("region")
    regions = (texts.join(asked, same_row(texts, asked))
               .select("h", *ROW, "s", "n_starts", (~F.col("full")).alias("open"), "regions", region))
    regions = written(regions, "suffix-regions")
    some = (regions.where(F.col("regions") <= HOT).repartition("h").sortWithinPartitions("h")
            .select("h", *ROW, "s", "n_starts", "open", "region").mapInArrow(settle_pass, RUN_SCHEMA))
    key = Window.partitionBy("h", "key").orderBy(*ROW, "s")
    hot = (regions.where(F.col("regions") > HOT).select("h", *ROW, "s", "n_starts", "open", "region")
           .mapInArrow(key_pass, KEY_SCHEMA)
           .withColumns({"before": F.lag("t1").over(key), "after": F.lead("t1").over(key)})
           .where("open AND (before IS NOT NULL OR after IS NOT NULL)").select(*ROW, F.col("s").alias("lo"), F.col("s").alias("hi")))
    whole = (pairs.where("full")
             .select(*ROW, F.col("s").alias("lo"), (F.col("s") + F.col("n_starts") - 1).alias("hi")))
    return whole.unionByName(some).unionByName(hot)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes (binary), one row per row of ``docs``."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit(1), text_col).alias("t2"),
                        F.col(text_col).alias("text"))
    runs = (repeated_starts(texts).withColumnsRenamed(THERE).groupBy(*THERE.values())
            .agg(F.collect_list(F.struct("lo", "hi")).alias("runs")))
    return (texts.join(runs, same_row(texts, runs), "left").select("doc_id", "text", "runs")
            .mapInArrow(cut_pass, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"))


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
