"""Encoding of a corpus with a public tokenizer."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe


def encode_corpus(df: DataFrame, id_col: str, text_col: str, ranks_path: str | None = None) -> DataFrame:
    """(id, ids): the token ids of each row's text, without special tokens.

    One pass without a shuffle; the rows keep their partitions, so a text that
    half the corpus repeats needs no care. Null and empty texts give an empty
    list, repeated rows stay repeated, other columns are left behind and may
    have any name. Texts are encoded whole whatever their length.
    """
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def encode(batches):
        codec = bpe.load(ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), codec.encode(part.column(1))], names=[id_col, "ids"])

    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(encode, schema)


def count_tokens(df: DataFrame, id_col: str, text_col: str, ranks_path: str | None = None) -> DataFrame:
    """(id, tokens bigint): the number of tokens of each row's text; 0 for null and empty texts."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("tokens", T.LongType())])

    def count(batches):
        codec = bpe.load(ranks_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(codec.counts(batch.column(1)), pa.int64())], names=[id_col, "tokens"]
            )

    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(count, schema)


def decode_corpus(df: DataFrame, id_col: str, ids_col: str, ranks_path: str | None = None) -> DataFrame:
    """(id, text) of rows of token ids, the inverse of encode_corpus; null and empty lists give an empty text, bytes that are no UTF-8 the replacement character."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def decode(batches):
        token = bpe.load(ranks_path).token
        for batch in batches:
            texts = [b"".join(map(token.__getitem__, ids or ())).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(F.col(id_col), F.col(ids_col).cast("array<int>").alias("__ids")).mapInArrow(decode, schema)
