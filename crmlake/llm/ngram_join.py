"""Similarity join on word n-grams: documents whose sets of distinct n-word
shingles have a Jaccard similarity of at least ``percent`` / 100 are linked.

Method (prefix filtering, rarest shingles first):

1. One pass over all texts counts shingles in a table of ``2**BIN_BITS`` hash
   bins (fixed size, so it may be broadcast) and writes one narrow row per document:
   set size, a 128-bit fingerprint of the set, and set sizes per hash cell. Equal
   sets form a class at once.
2. The order "bin count, then hash" is the same for all documents and puts rare
   shingles first. A second pass emits each document's prefix: a pair above the
   threshold must share a prefix shingle. Copies inside one task emit once.
3. Round one joins every posting with the pivot of its shingle's list, under the
   length and positional filters. The pivot is the document in whose prefix the shingle
   comes first: own rare shingles push common ones back, so that is the least
   altered copy, to which the others are closest. Links found give components.
4. Round two joins only postings of lists that still span several components, and
   only across components (length and positional filters again), so a group of
   near copies never expands into all its pairs and no link between components is
   missed. Pairs of round one aren't verified again.

Before texts are fetched, the suffix filter bounds the overlap of a pair by its
set sizes per hash cell; what is left is verified exactly, once per pair, on the
64-bit shingle hashes of the whole texts. Lists of very common shingles (bin count
over ``SALT_ABOVE`` more than the average bin's, which is what other shingles add to a bin) are salted in
round one; a large corpus fills all bins alike and salts no more lists for it.

Words are runs of ``[^\\x20\\x09-\\x0D]``, A-Z lower-cased; a text with fewer words than
n is one shingle of all of them; a text without words has no shingle and no link.
Rows: null text is empty; rows without id get no component; rows that share an id
are one node. Ties don't matter (the component is the smallest id).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crmlake.llm import textvec as tv
from crmlake.llm.common import connected_components, documents, written

BIN_BITS = 21
COUNT_CHUNKS = 16
CELLS = 32
SALT_ABOVE = 50_000
DOC_SCHEMA = "chunk int, doc_id long, n int, f1 long, f2 long, cells array<int>, counts binary"
POST_SCHEMA = "token long, salt int, doc_id long, n int, pos int"
PAIR_SCHEMA = "a long, b long"


def document_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Shingle sets (sorted hashes) of the documents of a chunk."""
    _, _, hashes, doc = tv.words(buf, offsets, tv.whitespace_words())
    cut = np.searchsorted(doc, np.arange(len(offsets)))
    return [tv.shingle_set(hashes[cut[i]:cut[i + 1]], k) for i in range(len(offsets) - 1)]


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes, as two signed integers."""
    a, b = tv.mix(s), tv.mix(s ^ np.uint64(tv.BASE))
    return tuple(int(x.sum(dtype=np.uint64).astype(np.int64)) for x in (a, b))


def count_pass(k: int):
    """Narrow document rows, and at the end of a task its bin counts in chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, any_rows = np.zeros(1 << BIN_BITS, np.uint32), False
        mask = np.uint64((1 << BIN_BITS) - 1)
        for rows, buf, offsets in tv.chunks(batches, "text"):
            any_rows = True
            sets = document_sets(buf, offsets, k)
            flat = np.concatenate(sets)
            bins += np.bincount((flat & mask).astype(np.int64), minlength=len(bins)).astype(np.uint32)
            prints = [fingerprint(s) for s in sets]
            cells = [np.bincount((s >> np.uint64(59)).astype(np.int64), minlength=CELLS) for s in sets]
            n = len(sets)
            yield pa.RecordBatch.from_arrays([
                pa.nulls(n, pa.int32()), rows.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()),
                pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * CELLS, pa.int32()), pa.array(np.concatenate(cells), pa.int32())),
                pa.nulls(n, pa.binary())], names=["chunk", "doc_id", "n", "f1", "f2", "cells", "counts"])
        if any_rows:
            parts = [zlib.compress(p.tobytes(), 1) for p in np.split(bins, COUNT_CHUNKS)]
            n = len(parts)
            yield pa.RecordBatch.from_arrays([
                pa.array(range(n), pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()),
                pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32())), pa.array(parts, pa.binary())],
                names=["chunk", "doc_id", "n", "f1", "f2", "cells", "counts"])
    return run


def add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the bin counts per chunk; holds one array per chunk, whatever comes in."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(blob), np.uint32).astype(np.int64)
            total[chunk] = total.get(chunk, 0) + part
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in total.values()], pa.binary())],
            names=["chunk", "counts"])
    total.clear()
    tv.release_memory()


def bin_counts(rows: DataFrame) -> np.ndarray:
    """The whole table of counts: 2**BIN_BITS integers, however large the input."""
    parts = (rows.where("chunk IS NOT NULL").select("chunk", "counts").repartition(COUNT_CHUNKS, "chunk")
             .mapInArrow(add_counts, "chunk int, counts binary").collect())
    out = np.zeros(1 << BIN_BITS, np.int64)
    size = len(out) // COUNT_CHUNKS
    for chunk, blob in parts:
        out[chunk * size:(chunk + 1) * size] = np.frombuffer(zlib.decompress(bytes(blob)), np.int64)
    return out


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def prefix_pass(k: int, percent: int, counts):
    """Postings (shingle, document, set size, position) of each document's prefix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = counts.value, set()
        mask, filled = np.uint64((1 << BIN_BITS) - 1), int(table.mean())
        for rows, buf, offsets in tv.chunks(batches, "text"):
            out: list[tuple[np.ndarray, ...]] = []
            for doc, s in zip(rows.column("doc_id").to_pylist(), document_sets(buf, offsets, k), strict=True):
                if doc is None or not len(s) or (key := fingerprint(s)) in seen:
                    continue
                seen.add(key)
                known = table[(s & mask).astype(np.int64)]
                first = np.lexsort((s, known))[:prefix_length(len(s), percent)]
                parts = -(-(known[first] - filled) // SALT_ABOVE)
                salt = np.where(parts > 1, (doc * 2654435761 & 0x7FFFFFFF) % np.maximum(parts, 1) + 1, 0)
                m = len(first)
                out.append((s[first].astype(np.int64), salt, np.full(m, doc), np.full(m, len(s)), np.arange(m)))
            if out:
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                                 names=["token", "salt", "doc_id", "n", "pos"])
    return run


def verify_pass(k: int, percent: int):
    """Pairs whose whole texts reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                left, right = (document_sets(*tv.text_buffer(part.column(c)), k) for c in ("ta", "tb"))
                both = [np.intersect1d(x, y, assume_unique=True).size for x, y in zip(left, right, strict=True)]
                ok = [100 * i >= percent * (len(x) + len(y) - i) > 0 for i, x, y in zip(both, left, right, strict=True)]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in (part.column("a"), part.column("b"))],
                                                 names=["a", "b"])
        tv.release_memory()
    return run


def _close(percent: int, n1: str, p1: str, n2: str, p2: str):
    """Length and positional filters for two postings of one shingle."""
    n1, p1, n2, p2 = (F.col(c).cast("long") for c in (n1, p1, n2, p2))
    left = F.least(n1 - p1, n2 - p2)     # this shingle and all after it
    return ((100 * F.least(n1, n2) >= percent * F.greatest(n1, n2))
            & ((100 + percent) * left >= percent * (n1 + n2)))


def links(pairs: DataFrame, narrow: DataFrame, texts: DataFrame, k: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) that are similar: suffix filter, then whole texts."""
    side = lambda x: narrow.select(*[F.col(c).alias(x + c) for c in ("doc_id", "n", "f1", "f2", "cells")])
    both = (pairs.join(side("a_"), F.col("a") == F.col("a_doc_id")).join(side("b_"), F.col("b") == F.col("b_doc_id")))
    apart = F.aggregate(F.zip_with("a_cells", "b_cells", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x).cast("long")
    size = (F.col("a_n") + F.col("b_n")).cast("long")
    equal = (F.col("a_f1") == F.col("b_f1")) & (F.col("a_f2") == F.col("b_f2")) & (F.col("a_n") == F.col("b_n"))
    left = written(both.where((100 + percent) * (size - apart) >= 2 * percent * size)
                   .select("a", "b", equal.alias("same")).groupBy("a", "b").agg(F.max("same").alias("same")), f"{name}-pairs")
    own = texts.select(F.col("doc_id").alias("id"), "text")
    fetched = (left.where("NOT same").join(own, F.col("a") == F.col("id")).select("a", "b", F.col("text").alias("ta"))
               .join(own, F.col("b") == F.col("id")).select("a", "b", "ta", F.col("text").alias("tb")))
    return left.where("same").select("a", "b").unionByName(fetched.mapInArrow(verify_pass(k, percent), PAIR_SCHEMA))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per row of ``docs``."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(texts.mapInArrow(count_pass(k), DOC_SCHEMA), "join-documents")
    narrow = rows.where("chunk IS NULL").drop("chunk", "counts")
    counts = spark.sparkContext.broadcast(bin_counts(rows))
    order = Window.partitionBy("token", "salt").orderBy("pos", "n", "doc_id")
    pivot = lambda c: F.first(c).over(order).alias(f"pivot_{c}")
    listed = texts.mapInArrow(prefix_pass(k, percent, counts), POST_SCHEMA).select(
        "*", pivot("doc_id"), pivot("n"), pivot("pos"), F.lag("n").over(order).alias("prev"), F.lead("n").over(order).alias("next"))
    listed = written(listed.where("prev IS NOT NULL OR next IS NOT NULL OR salt > 0").drop("prev", "next", "salt"), "join-lists")
    one = written(listed.where(_close(percent, "n", "pos", "pivot_n", "pivot_pos") & (F.col("doc_id") != F.col("pivot_doc_id")))
                  .select(F.least("doc_id", "pivot_doc_id").alias("a"), F.greatest("doc_id", "pivot_doc_id").alias("b"))
                  .distinct(), "join-round1")
    classes = narrow.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("b"))
    members = (narrow.where("doc_id IS NOT NULL").join(classes, ["n", "f1", "f2"]).select(F.col("doc_id").alias("a"), "b")
               .where("a <> b"))
    linked = written(members.unionByName(links(one, narrow, texts, k, percent, "round1")), "join-links1")
    label = connected_components(linked, "a", "b", "join-components1")
    placed = (listed.select("token", "doc_id", "n", "pos").join(label, F.col("doc_id") == F.col("node"), "left")
              .select("token", "doc_id", "n", "pos", F.coalesce("component", "doc_id").alias("c")))
    placed = written(placed, "join-placed")
    open_lists = placed.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token")
    rest = placed.join(open_lists, "token", "left_semi")
    x, y = (rest.select("token", *[F.col(c).alias(s + c) for c in ("doc_id", "n", "pos", "c")]) for s in ("x_", "y_"))
    across = (x.join(y, "token").where((F.col("x_c") < F.col("y_c")) & _close(percent, "x_n", "x_pos", "y_n", "y_pos"))
              .select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b")).distinct())
    two = written(across.join(one, ["a", "b"], "left_anti"), "join-round2")
    more = written(links(two, narrow, texts, k, percent, "round2"), "join-links2")
    if not more.isEmpty():
        label = connected_components(linked.unionByName(more), "a", "b", "join-components2")
    return (narrow.join(label, F.col("doc_id") == F.col("node"), "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that start their component (smallest id), all columns; rows without id stay."""
    found = ngram_join(docs, id_col, text_col, k, percent)
    drop = (found.where("component_id <> doc_id").select(F.col("doc_id").alias("__id")).distinct())
    return docs.join(drop, docs[id_col].cast("long") == drop["__id"], "left_anti")


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir))


OP7_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w),
t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p WHERE 100 * i >= 85 * (na + nb - i)),
linked AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT b.y, r.c FROM r JOIN linked b ON b.x = r.doc_id AND r.c < b.y),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(sh) AS n_shingles, component_id FROM s JOIN m USING (doc_id)
"""
