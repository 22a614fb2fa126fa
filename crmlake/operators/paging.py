"""Sort, limit, top-k and pagination.

``paginate`` completes every order with the list's remaining columns, so rows
that still tie are equal and a page is reproducible whatever sort keys it is
given. It has two physical strategies, which return the same rows:

* shallow pages: a top-K (``TakeOrderedAndProject``) of ``K = page *
  per_page`` rows. Each task keeps its best K rows and one task merges what
  every partition sends; the top-K is used only while that stays within
  ``shallow_bytes`` (64 MB by default, from the schema's widths and the
  number of partitions), so on a list of many partitions only the first pages take
  this path.
* all other pages: a ``PagedList``. The list is evaluated once, sorted over
  range partitions and written with one folder per partition, beside a directory:
  one row per partition with its first position, its size and its smallest
  sort keys. A page is looked up in the directory and reads only the one or two
  folders that hold it (partition pruning). The folder is a version of the list: any number of
  pages, by number or from a key on, read it without evaluating the list again.

The page number is clamped to ``[1, pages]`` with
``pages = max(1, ceil(total / per_page))`` as the reference does.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crmlake.session import ensure_checkpoint_dir
from crmlake.sources.sinks import cut_lineage

DEFAULT_PER_PAGE = 10
ACTIVITY_PER_PAGE = 20
SHALLOW_BYTES = 64 << 20   # what the merging task of a top-K may receive
TEXT_WIDTH = 64            # bytes assumed for a text value when a top-K is weighed


def order_spec(*cols) -> list[Column]:
    """Normalise ``("CreatedAt", "desc")`` / ``"Name"`` / Column into sort columns."""
    out = []
    for c in cols:
        if isinstance(c, Column):
            out.append(c)
        elif isinstance(c, tuple):
            name, direction = c
            out.append(F.col(name).desc() if direction == "desc" else F.col(name).asc())
        else:
            out.append(F.col(c).asc())
    return out


def top_n(df: DataFrame, order, n: int) -> DataFrame:
    """``ORDER BY ... LIMIT n`` (a bounded top-K, not a full sort)."""
    return df.orderBy(*order_spec(*order)).limit(n)


def global_index(df: DataFrame, order, name: str = "row_num",
                 total_name: str | None = None) -> DataFrame:
    """1-based position of each row in ``order``, computed without a
    single-partition window."""
    return _numbered(cut_lineage(df.orderBy(*order_spec(*order))), name, total_name)


def as_shown(df: DataFrame, name: str = "position") -> DataFrame:
    """1-based position of each row in the order in which ``df`` gives them (nothing is sorted
    here): what a report's reader sees, as a column."""
    return _numbered(cut_lineage(df), name)


def _numbered(ranked: DataFrame, name: str, total_name: str | None = None) -> DataFrame:
    """Positions of the rows of a checkpointed DataFrame."""
    with_pos = (ranked.withColumn("__pid", F.spark_partition_id())
                .withColumn("__mid", F.monotonically_increasing_id()))
    counts = with_pos.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition: the window below sees at most #partitions rows
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (counts.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)))
               .withColumn("__total", F.sum("__n").over(Window.partitionBy(F.lit(0))))
               .select("__pid", "__off", "__total"))
    out = with_pos.join(F.broadcast(offsets), "__pid")
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    out = out.withColumn(name, F.col("__off") + local + F.lit(1))
    if total_name:
        out = out.withColumn(total_name, F.col("__total"))
    return out.drop("__pid", "__mid", "__off", "__total")


def with_position(df: DataFrame, order, name: str = "position") -> DataFrame:
    """``df`` with the 1-based place of each row in the shown order (ties completed by the other columns)."""
    return global_index(df, _total_order(df, list(order)), name)


class PagedList:
    """A version of a list, sorted and written once, with a directory of its partitions.

    ``<path>/rows/__part=<n>`` holds the rows of range partition n, ``__at`` their place in
    it; ``<path>/directory`` has (part, first: position of the partition's first row, n: its rows,
    low: its smallest sort keys)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.rows = spark.read.parquet(f"{path}/rows")
        self.directory = spark.read.parquet(f"{path}/directory")

    @classmethod
    def build(cls, df: DataFrame, order, path: str | None = None) -> "PagedList":
        """Write ``df`` in ``order`` to ``path`` (default: a new folder in the shared checkpoint folder)."""
        spark, specs = df.sparkSession, list(order)
        path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/list-{uuid.uuid4().hex}"
        # written before it is sorted: sampling the sort's ranges would evaluate the list a second time;
        # zstd, as the whole list is written twice
        df.write.option("compression", "zstd").parquet(f"{path}/unsorted")
        found = spark.read.schema(df.schema).parquet(f"{path}/unsorted")
        placed = (found.orderBy(*_total_order(found, specs)).withColumn("__part", F.spark_partition_id())
                  .withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(F.col("__part").cast("long"), 33)))
        placed.write.option("compression", "zstd").partitionBy("__part").parquet(f"{path}/rows")
        keys = [k for k in _spec_names(specs) or [] if k in df.columns]
        first_row = F.when(F.col("__at") == 0, F.struct(*keys) if keys else F.struct("__at"))
        # schema given: a list without rows has no folders to infer it from
        rows = spark.read.schema(placed.schema).parquet(f"{path}/rows")
        sizes = rows.groupBy(F.col("__part").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.max(first_row).alias("low"))
        # one row per partition
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        (sizes.select("part", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).alias("first"), "n", "low")
         .coalesce(1).write.parquet(f"{path}/directory"))
        out = cls.__new__(cls)
        out.spark, out.path, out.rows, out.directory = spark, path, rows, spark.read.parquet(f"{path}/directory")
        return out

    def total(self) -> int:
        return self.directory.agg(F.sum("n")).first()[0] or 0

    def between(self, lo: int, hi: int) -> DataFrame:
        """The rows at positions ``lo`` to ``hi``, with ``row_num``; only their partitions are read."""
        found = (self.directory.where((F.col("first") <= hi) & (F.col("first") + F.col("n") > lo))
                 .select("part", "first").collect())           # the partitions that hold the range
        first, held = F.lit(None).cast("long"), F.lit(False)
        for r in found:
            own = F.col("__part") == r["part"]
            first = F.when(own, F.lit(r["first"])).otherwise(first)
            held = held | (own & F.col("__at").between(lo - r["first"], hi - r["first"]))
        return (self.rows.where(F.col("__part").isin([r["part"] for r in found]) & held)
                .withColumn("row_num", first + F.col("__at")).drop("__part", "__at"))

    def page(self, page: int, per_page: int = DEFAULT_PER_PAGE) -> DataFrame:
        """The rows of the (clamped) page with ``row_num`` and ``page``."""
        pages = max(1, -(-self.total() // per_page))
        page = min(max(1, int(page)), pages)
        return self.between((page - 1) * per_page + 1, page * per_page).withColumn("page", F.lit(page).cast("long"))

    def page_after(self, key: dict, per_page: int = DEFAULT_PER_PAGE) -> DataFrame:
        """The rows from the first one whose first sort columns (ascending, not null) equal or pass ``key``."""
        low = F.struct(*[F.col(f"low.{c}") for c in key])
        at = F.struct(*[F.lit(v).alias(c) for c, v in key.items()])
        # the key lies in the last partition that begins before it, or begins a later one
        held = self.directory.where(low < at).agg(F.max("part")).first()[0]
        held = held if held is not None else (self.directory.agg(F.min("part")).first()[0] or 0)
        start = self.directory.where(F.col("part") == held).select("first", "n").first()
        if start is None:
            return self.between(1, 0)
        inside = (self.rows.where((F.col("__part") == held) & (F.struct(*[F.col(c) for c in key]) >= at))
                  .agg(F.min("__at")).first()[0])
        lo = start["first"] + (inside if inside is not None else start["n"])
        return self.between(lo, lo + per_page - 1)


def _pages(total: Column, per_page: int) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(total / F.lit(per_page)).cast("long"))


def paginate(df: DataFrame, order, page: int = 1,
             per_page: int = DEFAULT_PER_PAGE, shallow_bytes: int = SHALLOW_BYTES) -> DataFrame:
    """The rows of one page, with ``row_num`` (position in the full list)
    and ``page`` (the clamped page number) columns."""
    specs = list(order)
    page = max(1, int(page))
    need = page * per_page
    width = sum(TEXT_WIDTH if f.dataType.typeName() in ("string", "binary", "array", "map", "struct") else 8 for f in df.schema.fields)
    if need * width > shallow_bytes or need * width * _partitions(df) > shallow_bytes:
        return PagedList.build(df, specs).page(page, per_page)
    order = _total_order(df, specs)
    top = df.orderBy(*order).limit(need)
    whole = Window.partitionBy(F.lit(0))
    numbered = (top.withColumn("row_num", F.row_number().over(Window.orderBy(*order)).cast("long"))
                .withColumn("__seen", F.count(F.lit(1)).over(whole)))
    # fewer than ``need`` rows means the top-K holds the whole list
    eff = (F.when(F.col("__seen") < need,
                  F.least(F.lit(page).cast("long"), _pages(F.col("__seen"), per_page)))
           .otherwise(F.lit(page).cast("long")))
    out = numbered.withColumn("page", eff)
    out = out.filter((F.col("row_num") > (F.col("page") - 1) * per_page)
                     & (F.col("row_num") <= F.col("page") * per_page))
    return out.drop("__seen")


def _total_order(df: DataFrame, specs) -> list[Column]:
    """The sort columns followed by every other column of the list."""
    keys = _spec_names(specs) or []
    return order_spec(*specs) + [F.col(c).asc() for c in df.columns if c not in keys]


def _partitions(df: DataFrame) -> int:
    """Partitions that may feed a top-K, without a job: input files, shuffle
    partitions or parallelism. It weighs the two strategies only; their rows are the same."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism,
               len(df.inputFiles()))


def _spec_names(specs) -> list[str] | None:
    """Column names of name / (name, direction) sort specs; None when a spec
    is an arbitrary Column expression."""
    names = []
    for sp in specs:
        if isinstance(sp, str):
            names.append(sp)
        elif isinstance(sp, tuple):
            names.append(sp[0])
        else:
            return None
    return names


def page_meta(df: DataFrame, page: int = 1, per_page: int = DEFAULT_PER_PAGE) -> DataFrame:
    """One row: page, pages, total, per_page, has_prev, has_next and
    the "showing first-last of total" range."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    pages = _pages(F.col("total"), per_page)
    eff = F.least(F.lit(max(1, int(page))).cast("long"), pages)
    return (total.withColumn("pages", pages)
            .withColumn("page", eff)
            .withColumn("per_page", F.lit(per_page).cast("long"))
            .withColumn("has_prev", F.col("page") > 1)
            .withColumn("has_next", F.col("page") < F.col("pages"))
            .withColumn("first_row", (F.col("page") - 1) * per_page + 1)
            .withColumn("last_row", F.least(F.col("page") * per_page, F.col("total")))
            .withColumn("show_bar", F.col("pages") > 1)
            .select("page", "pages", "total", "per_page", "has_prev", "has_next",
                    "first_row", "last_row", "show_bar"))
