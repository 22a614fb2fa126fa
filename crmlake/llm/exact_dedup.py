"""Exact deduplication with an extendible-hash index on shared files.

Native DataFrame code only. The index has a directory and pages:

* every text gets a 64-bit hash; its leading bits name a directory cell;
* the directory starts with one bucket and doubles: a bucket with more
  distinct hashes than a page holds splits on the next bit, the others keep
  their local depth. It has at most ``2**cell_bits`` entries, which bounds
  what is collected (counts per cell) and broadcast;
* owner tasks process key ranges, runs of buckets of like load, and are dealt by their number, not
  by a hash of it: the rows of a bucket meet in its owner, which compares the bytes of texts (they
  are grouping keys) and writes the pages. Texts with one hash but other bytes become a
  chain of that entry;
* hashes that hold over 1/10,000 of the rows (so at most 10,000) are salted:
  their copies meet in many tasks first, then one text per task is compared.

Rows: null text is empty; a row without id never wins over a row with one; of rows that
share an id and differ in white space only, the longest stays (then the smaller hash of the
original text); rows that repeat both id and text count as copies with one decision.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crmlake.llm.common import shuffle_partitions, without_spaces, written

PAGE_ENTRIES = 4096
CELL_BITS = 16
HOT_SHARE = 10_000
HOT_SALTS = 64


@dataclass
class Bucket:
    """Cells ``first`` to ``last`` share one page; ``depth`` leading bits name it."""
    first: int
    last: int
    depth: int
    entries: int


def grow_directory(counts: dict[int, int], cell_bits: int = CELL_BITS, capacity: int = PAGE_ENTRIES) -> list[Bucket]:
    """Split overfull buckets, one bit at a time, from one bucket over all cells.

    A bucket of a single cell is not split further: its page chains on."""
    buckets = [Bucket(0, (1 << cell_bits) - 1, 0, sum(counts.values()))]
    while any(b.entries > capacity and b.depth < cell_bits for b in buckets):   # the directory doubles
        split = []
        for b in buckets:
            if b.entries <= capacity or b.depth == cell_bits:
                split.append(b)
                continue
            middle = (b.first + b.last) // 2
            low = sum(counts.get(c, 0) for c in range(b.first, middle + 1))
            split += [Bucket(b.first, middle, b.depth + 1, low), Bucket(middle + 1, b.last, b.depth + 1, b.entries - low)]
        buckets = split
    return buckets


def directory_rows(buckets: list[Bucket], owners: int) -> list[tuple[int, int, int, int]]:
    """(cell, bucket, local depth, owner) per cell; owners take runs of buckets of like load."""
    total, before, rows = max(1, sum(b.entries for b in buckets)), 0, []
    for n, b in enumerate(buckets):
        owner = min(owners - 1, before * owners // total)
        rows += [(cell, n, b.depth, owner) for cell in range(b.first, b.last + 1)]
        before += b.entries
    return rows


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                page_entries: int = PAGE_ENTRIES, cell_bits: int = CELL_BITS) -> tuple[DataFrame, DataFrame]:
    """(keys, pages): the hash of every row, and the pages of the index.

    A page row is one hash value with its chain of texts: sha256, the row that
    stays (longest original, then smallest id) and the number of copies."""
    spark = docs.sparkSession
    norm = without_spaces(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_points"),
                       F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("own"), norm.alias("norm"))
    keyed = rows.select("*", F.xxhash64("norm").alias("h"))
    cell = F.shiftrightunsigned("h", 64 - cell_bits).cast("int")
    keys = written(keyed.select("doc_id", "n_points", "own", "h", F.sha2("norm", 256).alias("sha")), "dedup-keys")
    sizes = written(keys.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "dedup-hashes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    # at most 2**cell_bits rows, and at most HOT_SHARE hashes with over total / HOT_SHARE rows each
    counts = {r[0]: r[1] for r in sizes.groupBy(cell.alias("cell")).count().collect()}
    owners = shuffle_partitions(spark)
    directory = spark.createDataFrame(directory_rows(grow_directory(counts, cell_bits, page_entries), owners),
                                      "cell int, bucket int, depth int, owner int")
    hot = sizes.where(F.col("n") > F.lit(max(64, total // HOT_SHARE))).select("h", F.lit(True).alias("hot"))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(HOT_SALTS)).cast("int")     # spreads repeated rows too
    placed = (keyed.withColumns({"cell": cell, "salt": salt}).join(F.broadcast(directory), "cell")
              .join(F.broadcast(hot), "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
              .withColumn("task", F.when(F.col("hot"), (F.col("owner") + F.col("salt") * max(1, owners // HOT_SALTS)) % owners)
                          .otherwise(F.col("owner"))))
    best = F.min(F.struct((-F.col("n_points")).alias("l"), F.col("doc_id").isNull().alias("z"), "doc_id", "own")).alias("best")
    met = (placed.repartitionById(owners, "task").groupBy("task", "owner", "hot", "bucket", "depth", "h", "norm")
           .agg(F.count(F.lit(1)).alias("n"), best))
    sha = F.sha2("norm", 256).alias("sha")
    pages = written(met.select("owner", "hot", "bucket", "depth", "h", sha, "n", "best",
                               F.when(F.col("hot"), F.col("norm")).alias("norm")), "dedup-pages")
    head = ["owner", "bucket", "depth", "h"]
    once = pages.where("NOT hot").select(*head, "sha", "n", "best")
    joined = (pages.where("hot").groupBy(*head, "norm").agg(F.sum("n").alias("n"), F.min("best").alias("best"))
              .select(*head, sha, "n", "best"))
    entry = F.struct("sha", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
                     (-F.col("best.l")).alias("keep_points"), F.col("best.own").alias("keep_own"))
    chains = once.unionByName(joined).groupBy(*head).agg(F.sort_array(F.collect_list(entry)).alias("chain"))
    # other bytes with the same hash and the same SHA-256 would be told apart by no lookup: fail instead
    whole = F.size(F.array_distinct("chain.sha")) == F.size("chain")
    return keys, chains.withColumn("chain", F.when(whole, F.col("chain")).otherwise(
        F.raise_error(F.lit("two texts share their hash and SHA-256")).cast(chains.schema["chain"].dataType)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                page_entries: int = PAGE_ENTRIES, cell_bits: int = CELL_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, chain_no, and own (hash of the original text)."""
    keys, pages = build_index(docs, id_col, text_col, page_entries, cell_bits)
    found = keys.join(pages.select("h", "chain"), "h")
    at = F.array_position("chain.sha", F.col("sha"))
    hit = found.select("doc_id", "n_points", "own", "sha", at.alias("chain_no"), F.element_at("chain", at.cast("int")).alias("e"))
    stays = (F.col("doc_id").eqNullSafe(F.col("e.keep_id")) & (F.col("n_points") == F.col("e.keep_points"))
             & (F.col("own") == F.col("e.keep_own")))
    return hit.select("doc_id", F.col("e.keep_id").alias("keep_id"), F.col("e.group_size").alias("group_size"),
                      stays.alias("kept"), F.col("sha").alias("text_sha256"), "chain_no", "own")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns; of rows that repeat id and text, one."""
    kept = (exact_dedup(docs, id_col, text_col).where("kept")
            .select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), F.col("own").alias("__hash")).distinct())
    own = docs.withColumns({"__own": F.sha2(without_spaces(F.col(text_col)), 256), "__text": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    same = (own[id_col].cast("long").eqNullSafe(kept["__id"]) & (own["__own"] == kept["__sha"]) & (own["__text"] == kept["__hash"]))
    joined = own.join(kept, same, "left_semi")
    return joined.dropDuplicates([id_col, "__own"]).drop("__own", "__text")


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from crmlake.llm.common import documents
    return exact_dedup(documents(spark, sf_dir)).drop("chain_no", "own")


OP5_SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
g AS (
  SELECT norm, count(*) AS group_size, sha256(norm) AS text_sha256,
         (array_agg(doc_id ORDER BY points DESC, doc_id))[1] AS keep_id FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, g.text_sha256
FROM n JOIN g USING (norm)
"""
