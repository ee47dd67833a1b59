"""Memories as JSON documents, and conversations of chat databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def to_documents(memories: DataFrame) -> DataFrame:
    """(memory_id, document): each memory as one JSON text."""
    return memories.select("memory_id", F.to_json(F.struct(*memories.columns)).alias("document"))


def from_documents(documents: DataFrame, schema: str) -> DataFrame:
    return documents.select(F.from_json("document", schema).alias("m")).select("m.*")


def write_json(memories: DataFrame, path: str) -> None:
    memories.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_chat_database(spark: SparkSession, url: str, driver: str, partitions: int = 16, **bounds: str) -> DataFrame:
    """Message rows of a chat database over JDBC, read in ranges of time_created where bounds are given."""
    reader = spark.read.format("jdbc").option("url", url).option("driver", driver).option("dbtable", "session_message")
    if bounds:
        reader = reader.option("partitionColumn", "time_created").option("numPartitions", partitions)
        for key, value in bounds.items():
            reader = reader.option(key, value)
    return reader.load().select("id", "session_id", "type", "seq", "time_created", "data")


def with_parts(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Messages of the older layout, whose parts are rows of their own, with the parts' texts in order of id."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", F.get_json_object("data", "$.text").alias("t")))), lambda x: x["t"]), "\n")
    return messages.join(parts.groupBy(F.col("message_id").alias("id")).agg(text.alias("text")), "id", "left")
