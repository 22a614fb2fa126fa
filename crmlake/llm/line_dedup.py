"""Line deduplication over overlapping three-line windows (native DataFrame code).

Every run of three consecutive lines is hashed; a window that also starts
elsewhere (same document included) is repeated. The first occurrence, by
document id and line number, stays; the lines of later occurrences are removed,
and overlapping windows merge into spans. Windows without any visible
character don't count. Documents of fewer than three lines stay as they are.

Work grows with the lines of a document, not with their square: covered lines are runs between
sorted hits, and the kept lines are slices between runs.

Rows: null text is empty; rows without id come after all others; rows that repeat
an id are one document for the order, so equal windows at the same place of them
are all first. Two 64-bit hashes with different seeds identify a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crmlake.llm.common import SPACE_CHARS

WINDOW_LINES = 3


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     window: int = WINDOW_LINES) -> DataFrame:
    """(doc_id, line): later occurrences of windows, by their first line (from 0)."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    starts = F.sequence(F.lit(0), F.size("lines") - window)

    def nth(k):
        return F.transform(starts, lambda i: F.get("lines", i + k)).alias(f"l{k}")

    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), lines.alias("lines"))
            .where(F.size("lines") >= window)
            .select("doc_id", F.posexplode(F.arrays_zip(*[nth(k) for k in range(window)])).alias("line", "w")))
    members = [F.col(f"w.{f.name}") for f in rows.schema["w"].dataType.fields]
    visible = F.trim(F.concat(*members), F.lit(SPACE_CHARS)) != ""
    hashed = rows.where(visible).select(
        "doc_id", "line", F.xxhash64(*members).alias("h1"), F.xxhash64(F.lit(window), *members).alias("h2"),
        F.col("doc_id").isNull().alias("z"))
    at = F.struct("z", "doc_id", "line")
    first = (hashed.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.max(at).alias("last"))
             .where("first <> last"))
    return hashed.join(first, ["h1", "h2"]).where(at != F.col("first")).select("doc_id", "line")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_LINES) -> DataFrame:
    """All columns of ``docs`` with the text shortened, and n_lines, n_removed, n_spans (not to be among the columns already)."""
    clash = {"n_lines", "n_removed", "n_spans"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are taken by the result; rename them first")
    hits = (repeated_windows(docs, id_col, text_col, window)
            .groupBy(F.col("doc_id").alias("__id")).agg(F.sort_array(F.collect_set("line")).alias("__hits")))
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    joined = docs.withColumn("__lines", lines).join(hits, docs[id_col].cast("long").eqNullSafe(hits["__id"]), "left")
    # runs of covered lines: a hit begins one when no hit before it reaches it, and ends one likewise
    hit = F.coalesce("__hits", F.array().cast("array<int>"))
    begins = F.filter("__hit", lambda x, i: (i == 0) | (x - F.get("__hit", i - 1) > window))
    ends = F.filter("__hit", lambda x, i: (i == F.size("__hit") - 1) | (F.get("__hit", i + 1) - x > window))
    runs = (joined.withColumn("__hit", hit).withColumns({"__from": begins, "__to": F.transform(ends, lambda x: x + window)})
            .withColumn("__gone", F.aggregate(F.zip_with("__from", "__to", lambda a, b: b - a), F.lit(0), lambda s, x: s + x)))
    # the lines before each run, and after the last
    before = F.transform(F.sequence(F.lit(0), F.size("__from")), lambda j: F.struct(
        F.when(j == 0, 0).otherwise(F.get("__to", j - 1)).alias("a"),
        F.when(j == F.size("__from"), F.size("__lines")).otherwise(F.get("__from", j)).alias("b")))
    kept = F.flatten(F.transform("__keep", lambda p: F.slice("__lines", p["a"] + 1, p["b"] - p["a"])))
    return (runs.withColumn("__keep", before)
            .withColumns({"n_lines": F.size("__lines"), "n_removed": F.col("__gone"), "n_spans": F.size("__from"),
                          text_col: F.when(F.col("__gone") > 0, F.array_join(kept, "\n")).otherwise(F.col(text_col))})
            .drop("__id", "__hits", "__hit", "__lines", "__from", "__to", "__gone", "__keep"))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, n_spans, kept_sha256 (of the remaining text, null: empty)."""
    from crmlake.llm.common import documents
    out = line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", "n_spans",
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP9_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
windows AS (
  SELECT doc_id, pos, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS nth
  FROM windows WHERE c IS NOT NULL AND regexp_matches(a || b || c, '[^\\x20\\x09-\\x0D]')),
hit AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM ranked WHERE nth > 1),
runs AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) IS DISTINCT FROM pos - 1 AS opens FROM hit),
per_doc AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (opens) AS n_spans FROM runs GROUP BY doc_id),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (h.pos IS NULL), '') AS txt
  FROM lines l LEFT JOIN hit h ON h.doc_id = l.doc_id AND h.pos = l.pos GROUP BY l.doc_id)
SELECT k.doc_id, k.n_lines, coalesce(p.n_removed, 0) AS n_removed, coalesce(p.n_spans, 0) AS n_spans,
       sha256(k.txt) AS kept_sha256
FROM kept k LEFT JOIN per_doc p ON p.doc_id = k.doc_id
"""
