"""What is new since the last archived message of each session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sequences


def last_archived(states: DataFrame) -> DataFrame:
    """(session_id, last_seq): the highest seq that any saved state names for a session."""
    return states.select(F.explode("last_archived_seq").alias("session_id", "seq")).groupBy("session_id").agg(F.max("seq").alias("last_seq"))


def pending_tokens(messages: DataFrame, archived: DataFrame) -> DataFrame:
    """(session_id, tokens, last_seq): tokens beyond the session's last archived seq, where there are any.

    messages: session_id, seq, tokens.
    """
    rows = messages.join(archived, "session_id", "left").filter(F.col("seq") > F.coalesce("last_seq", F.lit(-1)))
    return rows.groupBy("session_id").agg(F.sum("tokens").alias("tokens"), F.max("seq").alias("last_seq")).filter("tokens > 0")


def unprocessed(events: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """Events whose id no state lists."""
    seen = states.select(F.explode("processed_message_ids").alias(key)).filter(F.col(key).isNotNull()).distinct()
    return events.join(seen, key, "left_anti")


def previous_seq(events: DataFrame) -> DataFrame:
    """Adds previous: the seq of the event before, by session."""
    order = ["seq", "delivery_id"]
    cut = sequences.stretches(events, "session_id", order)
    return sequences.neighbour(cut, "session_id", order, ["seq"], after=False).withColumn("previous", F.col("__next.seq")).drop("__next", sequences.PART)


def between(messages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Messages of each range's session with low < seq < high; ranges: (session_id, low, high), a null high is no end."""
    return messages.join(ranges, "session_id").filter("seq > low and (high is null or seq < high) and type <> 'compaction'")


def first_of_range(messages: DataFrame, ranges: DataFrame, most: int) -> DataFrame:
    """The first `most` messages of each range, in order of seq, with their number; ties by id."""
    w = Window.partitionBy("session_id").orderBy("seq", "id")
    return between(messages, ranges).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)


def due_sessions(pending: DataFrame, threshold: int, percent: int) -> DataFrame:
    """Sessions whose pending tokens reach the share of the threshold."""
    return pending.filter(F.col("tokens") >= threshold * percent / 100)


def by_family(sessions: DataFrame, families: DataFrame, most: int = 10) -> DataFrame:
    """(family, sessions, first): number of sessions by family (family, prefix), and the first `most` by id; the id is the prefix, or begins with it and a dash.

    The families are a dimension of a few rows; Spark broadcasts it by its size.
    Sessions of no family are `custom`. Ids differ.
    """
    match = (F.col("session_id") == F.col("prefix")) | F.startswith(F.col("session_id"), F.concat("prefix", F.lit("-")))
    rows = sessions.join(families, match, "left").select("session_id", F.coalesce("family", F.lit("custom")).alias("family"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("family").orderBy("session_id"))).filter(F.col("n") <= most)
    listed = first.groupBy("family").agg(F.array_join(F.array_sort(F.collect_list("session_id")), ",").alias("first"))
    return rows.groupBy("family").agg(F.count("*").alias("sessions")).join(listed, "family")
