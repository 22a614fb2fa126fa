"""Substring search that reads few files (F2): a table of character trigrams per file.

``LIKE '%q%'`` cannot prune a scan. ``GramIndex`` records, for each searched column, which
trigrams occur in which file of a stored table. A text that matches holds every
trigram of the pattern's literal parts (what stands between the wildcards), so only files
that hold them all, in one column, are read; the exact predicate then decides the
rows. A pattern without a literal part of three characters reads the whole table.

The index is built and asked by DataFrames: its rows are distinct (file, column, gram), combined in the
map tasks that read the file, and it is stored sorted by gram, so a lookup reads the row groups
of its few grams. What reaches the driver are names of files to read.

An index serves one text mode: ``binary`` (LIKE) holds the text as it is, ``ci`` (ILIKE) in lower
case. The accent-insensitive mode has no grams and reads the whole table.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crmlake.functions.predicates import clean_query, search, where

GRAM = 3


def _folded(text: Column, mode: str) -> Column:
    return F.lower(text) if mode == "ci" else text


def literal_parts(q: str) -> list[str]:
    """The parts of a LIKE pattern between its wildcards; a backslash makes the next character literal."""
    parts, part, i = [], "", 0
    while i < len(q):
        if q[i] == "\\" and i + 1 < len(q):
            part, i = part + q[i + 1], i + 1
        elif q[i] in "%_":
            parts, part = [*parts, part], ""
        else:
            part += q[i]
        i += 1
    return [p for p in [*parts, part] if p]


def grams_of(q: str) -> list[str]:
    """Distinct trigrams of the literal parts."""
    return sorted({p[i:i + GRAM] for p in literal_parts(q) for i in range(len(p) - GRAM + 1)})


class GramIndex:
    """``path/files``: (file_id, file); ``path/grams``: (gram, column, file_id), sorted by gram."""

    def __init__(self, spark: SparkSession, table: str, columns: list[str], path: str, mode: str):
        self.spark, self.table, self.columns, self.path, self.mode = spark, table, columns, path, mode

    @classmethod
    def build(cls, spark: SparkSession, table: str, columns: list[str], path: str, mode: str = "binary") -> "GramIndex":
        """Index the Parquet table at ``table`` as it is now; a changed table needs a new index."""
        if mode not in ("binary", "ci"):
            raise ValueError(f"no grams for mode {mode!r}")
        rows = spark.read.parquet(table).withColumn("file", F.input_file_name())
        # a file is known by a hash of its name in the narrow table, by its name in the other
        rows = rows.withColumn("file_id", F.xxhash64("file"))
        rows.select("file_id", "file").distinct().write.parquet(f"{path}/files")
        texts = F.array(*[F.struct(F.lit(c).alias("column"), _folded(F.col(c).cast("string"), mode).alias("text")) for c in columns])
        cut = F.transform(F.sequence(F.lit(1), F.length("t.text") - (GRAM - 1)), lambda i: F.substr("t.text", i, F.lit(GRAM)))
        grams = (rows.select("file_id", F.explode(texts).alias("t")).where(F.length("t.text") >= GRAM)
                 .select("file_id", "t.column", F.explode(cut).alias("gram")).distinct())
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)
        (grams.repartitionByRange(n, "gram").sortWithinPartitions("gram", "column", "file_id")
         .write.option("parquet.block.size", str(8 << 20)).parquet(f"{path}/grams"))
        return cls(spark, table, columns, path, mode)

    def files(self, q: str) -> list[str] | None:
        """Files that may hold a match; None when the pattern has no trigram (any file may)."""
        # lower case as the rows have it, of the whole pattern, as ILIKE does
        pattern = self.spark.range(1).select(_folded(F.lit(clean_query(q)), self.mode)).first()[0]
        grams = grams_of(pattern)
        if not grams:
            return None
        held = self.spark.read.parquet(f"{self.path}/grams").where(F.col("gram").isin(grams))
        ids = (held.groupBy("file_id", "column").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams))
               .select("file_id").distinct())
        named = self.spark.read.parquet(f"{self.path}/files")
        return [r[0] for r in named.join(ids, "file_id", "left_semi").select("file").collect()]

    def search(self, q: str, mode: str | None = None) -> DataFrame:
        """The rows of the table that ``predicates.search`` keeps, from the files that can have one."""
        mode = mode or self.mode
        whole = self.spark.read.parquet(self.table)
        found = self.files(q) if mode == self.mode and clean_query(q) else None
        if found is None:
            df = whole
        else:
            df = self.spark.read.schema(whole.schema).parquet(*found) if found else whole.limit(0)
        return where(df, search(self.columns, q, mode))
