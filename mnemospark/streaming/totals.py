"""Session totals, windowed counts and token thresholds that follow new rows.

Every follower writes what a micro-batch changed into a folder of that batch's
number, which the batch overwrites if it is run again; the last row of a key
holds. So a failure between output and checkpoint does no harm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import exists, new_folder, remove_folder


def _source(spark: SparkSession, path: str, schema, max_files: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").parquet(path)


def _run(stream: DataFrame, checkpoint: str, mode: str, write: Callable[[DataFrame, int], None]) -> None:
    """Reads what is there, in as many micro-batches as it takes."""
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _into(out: str) -> Callable[[DataFrame, int], None]:
    return lambda rows, number: rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/number={number}")


def session_totals(messages: DataFrame) -> DataFrame:
    """(session_id, messages, last_seq) - of a table or of a stream."""
    return messages.filter("session_id is not null").groupBy("session_id").agg(F.count("*").alias("messages"), F.max("seq").alias("last_seq"))


def follow_totals(spark: SparkSession, path: str, schema, max_files: int = 4) -> DataFrame:
    """The totals after a stream over the files at `path` has read what is there."""
    out = new_folder(spark, "totals")
    _run(session_totals(_source(spark, path, schema, max_files)), new_folder(spark, "checkpoint"), "update", _into(out))
    changes = spark.read.parquet(out)
    return changes.groupBy("session_id").agg(F.max_by("messages", "batch").alias("messages"), F.max_by("last_seq", "batch").alias("last_seq"))


def windowed_counts(events: DataFrame, time: str, width: str, keys: list[str], delay: str | None = "1 hour") -> DataFrame:
    """Counts and sums of `value` by tumbling window and keys, of a table or a stream; rows later than the delay are dropped by a stream, null times by both."""
    rows = events.withWatermark(time, delay) if events.isStreaming and delay else events
    sums = rows.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return sums.select(F.col("w.start").alias("start"), *keys, "n", "total")


def follow_windows(spark: SparkSession, path: str, schema, time: str, width: str, keys: list[str], delay: str | None = None, max_files: int = 4) -> DataFrame:
    """Windowed counts after a stream over the files at `path` has read what is there; windows that are still open as they stand.

    With a delay the state forgets windows that the watermark has passed, and
    later rows of theirs are lost; without one, files in any order give all rows.
    """
    out = new_folder(spark, "windows")
    _run(windowed_counts(_source(spark, path, schema, max_files), time, width, keys, delay), new_folder(spark, "checkpoint"), "update", _into(out))
    changes = spark.read.parquet(out)
    return changes.groupBy("start", *keys).agg(F.max_by(F.struct("n", "total"), "batch").alias("v")).select("start", *keys, "v.*")


def follow_events(spark: SparkSession, path: str, schema, out: str, checkpoint: str, *, backfill: bool = False, max_files: int = 4) -> DataFrame:
    """The rows that came since following began, as a table that further calls on the same `out` and `checkpoint` add to.

    The first call marks what is there as seen and writes nothing, unless
    `backfill`, with which history is followed like what comes later.
    """
    first = not exists(spark, checkpoint)
    write = _into(out)
    _run(_source(spark, path, schema, max_files), checkpoint, "append", (lambda rows, number: write(rows.limit(0), number)) if first and not backfill else write)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return spark.read.schema(names).parquet(out) if exists(spark, out) else spark.createDataFrame([], names)


def checkpoint_for(folder: str, tag: str | None) -> str:
    """The checkpoint of a source of that schema tag: another tag begins anew, and one that comes back goes on where it was."""
    return f"{folder}/schema-{tag or 'none'}"


def follow_thresholds(spark: SparkSession, path: str, schema, tokens: Column, line: int, out: str, checkpoint: str, max_files: int = 4) -> DataFrame:
    """(session_id, tokens, last_seq, batch): an event whenever the tokens of a session since its last one reach the line, which sets them back to 0.

    Tokens are summed by session within the micro-batch before they are
    shuffled, and added to what the session had pending, which is kept as a table
    of the last micro-batch; one event a session and batch. Rows without session
    are left out.
    """
    pending = f"{out}/pending"
    kept = "session_id string, tokens long, last_seq long, event boolean"

    def write(rows: DataFrame, number: int) -> None:
        new = rows.filter("session_id is not null").groupBy("session_id").agg(F.sum(tokens).alias("tokens"), F.max("seq").alias("last_seq"))
        before = f"{pending}/number={number - 1}"
        if number and exists(rows.sparkSession, before):
            old = rows.sparkSession.read.schema(kept).parquet(before).select("session_id", F.when(F.col("event"), 0).otherwise(F.col("tokens")).alias("tokens"), "last_seq", F.lit(True).alias("stale"))
            new = new.withColumn("stale", F.lit(False)).unionByName(old).groupBy("session_id").agg(F.sum("tokens").alias("tokens"), F.max("last_seq").alias("last_seq"), F.min("stale").alias("stale"))
        else:
            new = new.withColumn("stale", F.lit(False))
        state = new.select("session_id", "tokens", "last_seq", ((F.col("tokens") >= line) & ~F.col("stale")).alias("event"))
        state.write.mode("overwrite").parquet(f"{pending}/number={number}")
        state = rows.sparkSession.read.schema(kept).parquet(f"{pending}/number={number}")
        _into(f"{out}/events")(state.filter("event").drop("event"), number)
        if number > 1:  # no run again reaches further back than the batch before
            remove_folder(rows.sparkSession, f"{pending}/number={number - 2}")

    _run(_source(spark, path, schema, max_files), checkpoint, "append", write)
    names = "session_id string, tokens long, last_seq long, batch long"
    return spark.read.schema(names).parquet(f"{out}/events") if exists(spark, f"{out}/events") else spark.createDataFrame([], names)
