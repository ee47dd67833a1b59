"""Exactly one copy of messages delivered at least once.

Deliveries pass through a keyed state store of the identifiers seen, which
forgets an identifier once the event-time watermark has passed its last arrival
by the delay. What the store lets through is written in folders of its
micro-batch, which a batch that is run again overwrites, so that output and
checkpoint are one step: a restarted query neither loses nor repeats a delivery.
An identifier that comes back after the store forgot it is let through by the
store and found by the late-arrival lookup: among the identifiers written
before, but only in the batch's own buckets and only among those the store may
have forgotten.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import exists, materialize, move, new_folder, remove_folder, settings

#: Folders the identifiers written are dealt into; the lookup of a small batch reads only its own.
BUCKETS = 16
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def same_id(column: Column | str) -> Column:
    """Identifiers that differ by case or outer white space only are one; blank ones are none."""
    key = F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))
    return F.when(key != "", key)


def first_arrivals(stream: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """The first row of each key, as a streaming DataFrame; a key is remembered until `delay` after its event time."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def _seconds(delay: str) -> float:
    """Length of a delay such as `7 days`."""
    n, unit = delay.split()
    return float(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[unit.rstrip("s")]


def written(spark: SparkSession, out: str, schema) -> DataFrame:
    """What follow_deliveries has written to `out` so far: one delivery an identifier."""
    return spark.read.schema(schema).parquet(f"{out}/rows")


class Follower:
    """A stream from the Parquet files of `inbox` to one delivery of each identifier in `out`.

    inbox: rows (key, received_at, delivery_id). Used as a context manager; each
    call of `catch_up` returns when all files that are there have been read.
    `out` and `checkpoint` belong together and outlive the follower: the next
    one on the same two goes on where this one ended, in this session or
    another. Of the rows of one key the first that is handed in stays; files
    handed in together should hold a key once. A row whose received_at lies
    before what was read before is late: it counts as arriving now, so it is
    not lost to the watermark, and is looked up like any other.
    `rocksdb` keeps the state on the executors' disks, for a state beyond their
    memory; else the session's provider holds it.
    """

    def __init__(self, spark: SparkSession, inbox: str, out: str, checkpoint: str, schema, *, delay: str = "7 days", rocksdb: bool = False):
        self.spark, self.inbox, self.out, self.checkpoint, self.schema, self.delay = spark, inbox, out, checkpoint, schema, delay
        conf = {"spark__sql__streaming__noDataMicroBatches__enabled": "false"}
        if rocksdb:
            conf |= {"spark__sql__streaming__stateStore__providerClass": ROCKSDB, "spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled": "true"}
        self.settings = settings(spark, **conf)
        self.query = None

    def __enter__(self) -> Follower:
        newest = None
        if exists(self.spark, f"{self.out}/rows"):
            newest = written(self.spark, self.out, f"{_names(self.schema)}, seen_at timestamp").agg(F.max("seen_at")).first()[0]
        # a late row arrives now: it must not lie before the watermark, which would drop it
        seen = F.col("received_at") if newest is None else F.greatest("received_at", F.lit(newest))
        stream = self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.inbox)
        first = first_arrivals(stream.withColumn("seen_at", seen), "key", "seen_at", self.delay)
        with self.settings:
            self.query = first.writeStream.foreachBatch(self._write).option("checkpointLocation", self.checkpoint).start()
        return self

    def __exit__(self, *_) -> None:
        self.query.stop()

    def catch_up(self) -> None:
        self.query.processAllAvailable()

    def _write(self, batch: DataFrame, number: int) -> None:
        """Writes what the store let through, without what was written before and forgotten."""
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))
        spark, folder = batch.sparkSession, f"{self.out}/rows"
        if exists(spark, folder):
            known = spark.read.schema(f"{_names(self.schema)}, seen_at timestamp, number long, bucket int").parquet(folder)
            known = known.filter(F.col("number") < number)
            if (newest := self._newest_before(number)) is not None:  # what the store still holds it cannot have let through again
                known = known.filter(F.col("seen_at").cast("double") <= F.lit(newest - _seconds(self.delay)))
            rows = rows.join(known.select("bucket", "key"), ["bucket", "key"], "left_anti")
        # a few files a bucket, as many as its rows fill
        rows.select("key", "received_at", "delivery_id", "seen_at", "bucket").hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/number={number}")


    def _newest_before(self, number: int) -> float | None:
        """Seconds of the latest event of the batch before; None, which bounds nothing, if this is the follower's first."""
        last = self.query.lastProgress if self.query else None
        if last is None or last["batchId"] != number - 1 or "max" not in last["eventTime"]:
            return None
        return dt.datetime.fromisoformat(last["eventTime"]["max"]).timestamp() + 1  # reported in milliseconds


def _names(schema) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)


def write_slices(keyed: DataFrame, folder: str, slices: int) -> list[str]:
    """(key, received_at, delivery_id) as folders of Parquet, one for each slice of arrival time; the folders in order.

    Within a slice each identifier keeps its earliest delivery only. The
    aggregation starts before the shuffle, so an identifier that holds a third
    of all rows sends a row a task and slice; the tasks that end it write the
    slices, as many as the data fill.
    """
    spark = keyed.sparkSession
    span = keyed.agg(F.min("received_at").cast("double").alias("a"), F.max("received_at").cast("double").alias("b")).first()
    if span["a"] is None:
        return []
    width = max((span["b"] - span["a"]) / slices, 1e-6)
    part = F.least(F.floor((F.col("received_at").cast("double") - F.lit(span["a"])) / F.lit(width)), F.lit(slices - 1)).cast("int")
    earliest = keyed.groupBy("key", part.alias("slice")).agg(F.min(F.struct("received_at", "delivery_id")).alias("d"))
    earliest.select("key", "d.received_at", "d.delivery_id", "slice").write.partitionBy("slice").parquet(folder)
    return [f"{folder}/slice={i}" for i in range(slices) if exists(spark, f"{folder}/slice={i}")]


def keep_one_delivery(
    deliveries: DataFrame,
    states: DataFrame | None = None,
    *,
    delay: str = "7 days",
    slices: int = 6,
    out: str | None = None,
    checkpoint: str | None = None,
    rocksdb: bool = False,
) -> DataFrame:
    """(delivery_id): the deliveries to keep, of columns delivery_id, message_id, received_at.

    Of the deliveries of one identifier (see same_id) the earliest stays, by
    received_at, then delivery_id - unless a row of `states` (saved_at,
    processed_message_ids) that lists the identifier was saved before it came.
    Deliveries without identifier all stay, and so do those without
    received_at, which cannot be ordered. Null lists, null, blank and repeated
    list entries, entries unknown to the deliveries and empty tables have no
    effect. Extra columns are ignored. `delay` bounds the state, not the result.

    The table is replayed in `slices` of arrival time, one micro-batch each.
    With `out` and `checkpoint` of the caller, further calls go on where this
    one ended: what an earlier call kept stays kept, its repetitions in later
    tables are dropped, and the result holds what all calls kept. Without them
    both are new folders and the call stands alone.
    """
    if (out is None) != (checkpoint is None):
        raise ValueError("output and checkpoint belong together")
    spark = deliveries.sparkSession
    rows = deliveries.select("delivery_id", same_id("message_id").alias("key"), "received_at")
    unkeyed = rows.filter("key is null or received_at is null").select("delivery_id")
    keyed = rows.filter("key is not null and received_at is not null")
    replayed, passing = new_folder(spark, "slices"), [] if checkpoint else [new_folder(spark, "checkpoint")]
    out, checkpoint = out or new_folder(spark, "seen"), checkpoint or passing[0]
    inbox = f"{out}/inbox"
    folders = write_slices(keyed.select("key", "received_at", "delivery_id"), replayed, slices)
    schema = keyed.select("key", "received_at", "delivery_id").schema
    if folders:
        move(spark, None, inbox)
        with Follower(spark, inbox, out, checkpoint, schema, delay=delay, rocksdb=rocksdb) as follower:
            for folder in folders:
                # a rename hands a whole slice to the source at once
                move(spark, folder, f"{inbox}/{new_folder(spark, 'slice').rsplit('/', 1)[1]}")
                follower.catch_up()
        for folder in (replayed, *passing):
            remove_folder(spark, folder)
    if not exists(spark, f"{out}/rows"):
        return unkeyed
    kept = written(spark, out, schema)
    if states is not None:
        listed = (
            states.select("saved_at", F.explode("processed_message_ids").alias("id"))
            .select(same_id("id").alias("key"), "saved_at")
            .filter("key is not null")
            .groupBy("key")
            .agg(F.min("saved_at").alias("saved_at"))
        )
        kept = kept.join(listed, "key", "left").filter("saved_at is null or not saved_at < received_at")
    return kept.select("delivery_id").unionByName(unkeyed)


def repeated_deliveries(deliveries: DataFrame, states: DataFrame | None = None, **options) -> DataFrame:
    """(delivery_id): the deliveries to drop, the complement of keep_one_delivery."""
    kept = materialize(keep_one_delivery(deliveries, states, **options), "kept")
    return deliveries.select("delivery_id").join(kept, "delivery_id", "left_anti")
