"""Activity log as a stream.

The reference appends one log row per user action. Here new entries arrive
as files in a landing folder; a Structured Streaming query picks them up
(file source, exactly-once bookkeeping in the checkpoint) and appends them
to the log. ``LogID`` continues the stream's own maximum and that of an
``existing`` log handed to ``start_activity_stream``. Entries without a time
get the time at which their batch was first run, which is recorded.

Each micro-batch is written to its own folder ``<log>/batch_id=<n>`` with
mode ``overwrite``: when a batch is replayed after a failure it rewrites the
same folder, so the log never holds a batch twice. Each batch also records
its largest key in ``<log>/_keys/batch_id=<n>`` (one row); key assignment
reads the maximum only of batches *before* the current one, so a replay
produces the same keys and no batch scans the log itself. A log is owned
by one stream checkpoint (batch ids are numbered per checkpoint); restart
the stream on the same checkpoint to continue it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crmlake.operators.paging import global_index
from crmlake.sources.readers import apply_defaults
from crmlake.sources.schemas import ACTIVITY_LOG
from crmlake.sources.sinks import read_if_exists

ENTRY_ORDER = ["CreatedAt", "Username", "Action", "Module", "Description", "IPAddress"]


def entries_from_events(events: DataFrame) -> DataFrame:
    """Shape raw event rows into activity entries (same mapping as the
    ``b_activity`` binding, without the key, which the log assigns)."""
    action = (F.when(F.col("event_type") == "view", "LOGIN")
              .when(F.col("event_type") == "purchase", "LOGOUT")
              .when(F.col("event_type") == "signup", "CREATE")
              .when(F.col("event_type") == "click", "UPDATE").otherwise("DELETE"))
    module = F.element_at(F.array(*[F.lit(m) for m in
                                    ["Auth", "Customer", "Opportunity", "Interaction", "Ticket", "User"]]),
                          (F.col("event_id") % 6 + 1).cast("int"))
    user = F.col("user_id").cast("string")
    return events.select(
        F.concat(F.lit("u"), user).alias("Username"),
        F.concat(F.lit("User "), user).alias("FullName"),
        action.alias("Action"), module.alias("Module"),
        F.col("props").alias("Description"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")).alias("IPAddress"),
        F.col("ts").alias("CreatedAt"),
        F.col("event_id").alias("seq"))


def _batch_time(spark: SparkSession, path: str) -> str:
    """The time of a batch: recorded at its first run, so a replay stamps the same one."""
    known = read_if_exists(spark, path, "stamp string")
    if known is None:
        spark.range(1).select(F.localtimestamp().cast("string").alias("stamp")).coalesce(1).write.parquet(path)
        known = spark.read.schema("stamp string").parquet(path)
    return known.first()[0]


def _append_batch(log_root: str, order: list, as_of, first_free: int) -> callable:
    keys_root = f"{log_root}/_keys"  # hidden from readers of the log (leading underscore)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # one tiny row per earlier batch, not a scan of the log
        keys = read_if_exists(spark, keys_root, "max_key long, batch_id long")
        prior = first_free - 1
        if keys is not None:
            last = keys.filter(F.col("batch_id") < batch_id).agg(F.max("max_key")).first()[0]
            prior = max(prior, last or 0)
        stamp = as_of or _batch_time(spark, f"{log_root}/_times/batch_id={batch_id}")
        numbered = global_index(batch, order, "__pos")
        rows = numbered.withColumn("LogID", F.lit(prior).cast("long") + F.col("__pos")).drop("__pos")
        rows = apply_defaults(rows, ACTIVITY_LOG, stamp)
        rows.write.mode("overwrite").parquet(f"{log_root}/batch_id={batch_id}")
        top = spark.read.parquet(f"{log_root}/batch_id={batch_id}").agg(
            F.coalesce(F.max("LogID"), F.lit(prior).cast("long")).alias("max_key"))
        top.coalesce(1).write.mode("overwrite").parquet(f"{keys_root}/batch_id={batch_id}")
    return write


def start_activity_stream(spark: SparkSession, source: DataFrame, log_root: str, checkpoint: str,
                          as_of=None, order: list | None = None, available_now: bool = True,
                          existing: DataFrame | None = None):
    """Start the append stream. ``source`` is a streaming DataFrame of
    activity entries (columns of the log except ``LogID``); returns the
    ``StreamingQuery``. ``available_now`` processes what has landed and
    stops (batch-like runs); otherwise it keeps polling. ``as_of`` fixes the
    time of undated entries (default: the time of their batch). ``existing``
    is an earlier log kept elsewhere: new keys follow its largest ``LogID``,
    read once here, so pass the same log when the stream is restarted."""
    first_free = 1
    if existing is not None:
        first_free += existing.agg(F.max("LogID")).first()[0] or 0
    writer = (source.writeStream.foreachBatch(_append_batch(log_root, order or ENTRY_ORDER + ["seq"],
                                                            as_of, first_free))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def event_stream(spark: SparkSession, folder: str, file_glob: str = "events*.parquet",
                 schema: T.StructType | None = None) -> DataFrame:
    """File-source stream of event files landing in ``folder``."""
    if schema is None:
        schema = spark.read.parquet(folder).schema if file_glob is None else \
            spark.read.option("pathGlobFilter", file_glob).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    return reader.parquet(folder)


def read_log(spark: SparkSession, log_root: str) -> DataFrame:
    return spark.read.parquet(log_root).select(*[c.name for c in ACTIVITY_LOG.columns])
