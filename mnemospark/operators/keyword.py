"""A keyword index kept as tables: postings, documents and totals, changed by increments.

Each change is a generation. A generation's postings (term, id, tf, dl) lie in
buckets of the term's hash, sorted by term, so that a query reads the files of
its own terms and no text. A document that is indexed again or removed leaves
its old postings where they are and a row in `dead`, which queries anti-join;
`compact` rewrites what is alive. Totals are a row a generation.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import query_terms, search_tokens
from ..session import exists, move, remove_folder

K1, B = 1.2, 0.75
BUCKETS = 64


def term_frequencies(df: DataFrame, id_col: str, text_col: str, by: list[str] | None = None) -> DataFrame:
    """(id, *by, term, tf, dl): counted batch by batch where the texts are read; a text without words has one row with a null term."""
    by = by or []
    words = search_tokens(F.coalesce(F.col(text_col), F.lit("")))
    rows = df.select(F.col(id_col).alias("id"), *by, words.alias("__words"))
    keys = ["id", *by]

    def count(batches):
        for batch in batches:
            lists = batch.column(len(keys))
            n = pc.list_value_length(lists)
            table = pa.table({"row": pc.list_parent_indices(lists), "term": pc.list_flatten(lists)})
            counted = table.group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
            empty = pc.indices_nonzero(pc.equal(n, 0))
            row = pa.concat_arrays([pc.cast(counted["row"].combine_chunks(), pa.int64()), pc.cast(empty, pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i).take(row) for i in range(len(keys))),
                    pa.concat_arrays([counted["term"].combine_chunks(), pa.nulls(len(empty), pa.string())]),
                    pa.concat_arrays([counted["count_all"].combine_chunks(), pa.array([0] * len(empty), pa.int64())]),
                    pc.cast(n, pa.int64()).take(row),
                ],
                names=[*keys, "term", "tf", "dl"],
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(count, f"{kinds}, term string, tf long, dl long")


class KeywordIndex:
    """BM25 over the texts of a folder of index tables.

    `by` names columns that each have statistics of their own, such as a
    project. Ids are unique; null ids are left out. A text without words counts
    in the number and mean length of the documents, and is never found.
    """

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "string", by: dict[str, str] | None = None):
        self.spark, self.folder, self.by, self.id_type = spark, folder.rstrip("/"), by or {}, id_type
        self.keys = ", ".join(f"{n} {t}" for n, t in {"id": id_type, **self.by}.items())

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def postings(self) -> DataFrame:
        return self._table("postings", f"{self.keys}, term string, tf long, dl long, generation int, bucket int")

    def documents(self) -> DataFrame:
        """The documents alive: (id, *by, dl, generation)."""
        rows = self._table("documents", f"{self.keys}, dl long, generation int")
        return rows.join(self.dead(), ["id", "generation"], "left_anti")

    def dead(self) -> DataFrame:
        return self._table("dead", f"id {self.id_type}, generation int, ended int").select("id", "generation")

    def totals(self) -> DataFrame:
        """(*by, n, avgdl)."""
        rows = self._table("totals", ", ".join([*(f"{n} {t}" for n, t in self.by.items()), "n long, length long, generation int"]))
        return rows.groupBy(*self.by).agg(F.sum("n").alias("n"), (F.sum("length") / F.sum("n")).alias("avgdl")).filter("n > 0")

    def _next(self) -> int:
        last = self._table("totals", "n long, length long, generation int").agg(F.max("generation")).first()[0]
        return 0 if last is None else last + 1

    def _write(self, df: DataFrame, name: str, generation: int, by: list[str] | None = None) -> None:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.folder}/{name}/generation={generation}")

    def index(self, df: DataFrame, id_col: str, text_col: str) -> KeywordIndex:
        """Adds the texts, each in place of what its id had before."""
        generation = self._next()
        rows = term_frequencies(df.filter(F.col(id_col).isNotNull()), id_col, text_col, list(self.by))
        bucket = F.pmod(F.crc32(F.coalesce("term", F.lit(""))), F.lit(BUCKETS)).cast("int")
        staged = f"{self.folder}/staged"
        rows.withColumn("bucket", bucket).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(staged)
        there = self.spark.read.schema(f"{self.keys}, term string, tf long, dl long, bucket int").parquet(staged)
        docs = there.groupBy("id", *self.by).agg(F.max("dl").alias("dl"))
        self._finish(docs, self._versions(docs.select("id")), generation, staged)
        return self

    def unindex(self, ids: DataFrame) -> KeywordIndex:
        """Removes the documents of a column `id`; unknown ids have no effect."""
        generation = self._next()
        self._finish(None, self._versions(ids.select("id")), generation, None)
        return self

    def _versions(self, ids: DataFrame) -> DataFrame:
        return self.documents().join(ids.filter("id is not null").distinct(), "id", "left_semi")

    def _finish(self, docs: DataFrame | None, gone: DataFrame, generation: int, staged: str | None) -> None:
        """Writes all of a generation but its totals, and these last: a generation without totals is written anew by the next change."""
        dead = f"{self.folder}/ending"
        gone.write.mode("overwrite").parquet(dead)
        ended = self.spark.read.schema(f"{self.keys}, dl long, generation int").parquet(dead)
        minus = (-F.count("*")).alias("n"), (-F.coalesce(F.sum("dl"), F.lit(0))).alias("length")
        change = ended.groupBy(*self.by).agg(*minus)
        if docs is not None:
            self._write(docs, "documents", generation)
            added = self.spark.read.schema(f"{self.keys}, dl long").parquet(f"{self.folder}/documents/generation={generation}")
            change = change.unionByName(added.groupBy(*self.by).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")))
            target = f"{self.folder}/postings/generation={generation}"
            remove_folder(self.spark, target)
            move(self.spark, None, f"{self.folder}/postings")
            move(self.spark, staged, target)
        self._write_dead(ended, generation)
        self._write(change.groupBy(*self.by).agg(F.sum("n").alias("n"), F.sum("length").alias("length")), "totals", generation)
        remove_folder(self.spark, dead)

    def _write_dead(self, ended: DataFrame, generation: int) -> None:
        ended.select("id", "generation", F.lit(generation).alias("ended")).write.mode("overwrite").parquet(f"{self.folder}/dead/ended_by={generation}")

    def terms(self) -> DataFrame:
        """(term, *by, documents, occurrences) of all documents alive."""
        alive = self.postings().filter("term is not null").join(self.dead(), ["id", "generation"], "left_anti")
        return alive.groupBy("term", *self.by).agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"))

    def search(self, query: str, k1: float = K1, b: float = B) -> DataFrame:
        """(id, *by, score) of every document with a score above 0; duplicate query terms count twice."""
        asked, by = query_terms(query), list(self.by)
        if not asked:
            return self.postings().select("id", *by).limit(0).withColumn("score", F.lit(0.0))
        buckets = sorted({zlib.crc32(t.encode()) % BUCKETS for t in asked})
        hits = self.postings().filter(F.col("bucket").isin(buckets) & F.col("term").isin(list(asked)))
        hits = hits.join(self.dead(), ["id", "generation"], "left_anti")
        # a row a term (and value of `by`): from the terms' own postings, counted where they are read
        stats = hits.groupBy("term", *by).agg(F.count("*").alias("df"))
        totals = self.totals()
        known = stats.join(totals, by) if by else stats.crossJoin(F.broadcast(totals))
        times = F.element_at(F.create_map(*(F.lit(x) for t in asked.items() for x in t)), F.col("term"))
        weighted = hits.select("id", *by, "term", "tf", "dl").join(known, ["term", *by])
        return weighted.groupBy("id", *by).agg(F.sum(times * bm25_part(k1, b)).alias("score")).filter("score > 0")

    def compact(self) -> KeywordIndex:
        """One generation of what is alive, in the place of all."""
        generation = self._next()
        folder = f"{self.folder}/compacting"
        alive = self.postings().join(self.dead(), ["id", "generation"], "left_anti").drop("generation")
        alive.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/postings/generation={generation}")
        self.documents().drop("generation").write.mode("overwrite").parquet(f"{folder}/documents/generation={generation}")
        docs = self.spark.read.schema(f"{self.keys}, dl long").parquet(f"{folder}/documents/generation={generation}")
        docs.groupBy(*self.by).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).write.mode("overwrite").parquet(f"{folder}/totals/generation={generation}")
        for name in ("postings", "documents", "totals", "dead"):
            remove_folder(self.spark, f"{self.folder}/{name}")
            if name != "dead":
                move(self.spark, f"{folder}/{name}", f"{self.folder}/{name}")
        remove_folder(self.spark, folder)
        return self


def bm25_part(k1: float = K1, b: float = B) -> Column:
    """What one term adds to a document's score, of columns n, df, avgdl, tf and dl."""
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)))
