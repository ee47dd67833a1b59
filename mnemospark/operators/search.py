"""Keyword, vector and hybrid search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import relevance
from ..functions.vectors import cosine, dot, literal
from ..session import exists
from .keyword import KeywordIndex


def bm25(index: KeywordIndex, query: str) -> DataFrame:
    """(id, *by, score) of every document of the index with a score above 0."""
    return index.search(query)


def okapi(df: DataFrame, id_col: str, text_col: str, query: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(id, score) of every document, also with a score of 0: Okapi BM25 over texts and query cut at single blanks, case and empty words kept.

    The weight of a term is log(N - n + 0.5) - log(n + 0.5); where that is
    below 0, `epsilon` times the mean weight of all terms of the corpus.
    """
    cut = df.select(id_col, F.split(F.coalesce(F.col(text_col), F.lit("")), " ").alias("w"))
    totals = cut.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl"))
    weight = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    weights = cut.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(totals)).select("term", weight.alias("idf"))
    terms = query.split(" ")
    number_of = lambda t: F.size(F.filter("w", lambda w: w == t))
    asked = weights.agg(F.avg("idf").alias("mean"), *(F.max(F.when(F.col("term") == t, F.col("idf"))).alias(f"idf{i}") for i, t in enumerate(terms)))  # one row
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        tf = number_of(t)
        idf = F.when(F.col(f"idf{i}") < 0, epsilon * F.col("mean")).otherwise(F.col(f"idf{i}"))
        score = score + F.coalesce(idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.size("w") / F.col("avgdl"))), F.lit(0.0))
    return cut.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(asked)).select(id_col, score.alias("score"))


def top(df: DataFrame, k: int, id_col: str, score: str = "score", by: list[str] | None = None) -> DataFrame:
    """The k best, ties by id (within each value of `by`), with their rank."""
    order = [F.col(score).desc(), F.col(id_col)]
    if not by:
        best = df.orderBy(*order).limit(k)  # k rows
        return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def vector_scores(df: DataFrame, id_col: str, vector_col: str, query: list[float], normalised: bool = True) -> DataFrame:
    """(id, score): cosine (or inner product) with the query, above 0; vectors of another length are left out."""
    rows = df.filter(F.size(vector_col) == len(query))
    score = cosine(F.col(vector_col), query) if normalised else dot(F.col(vector_col), literal(query))
    return rows.select(id_col, score.alias("score")).filter("score > 0")


def fuse_ranks(lists: list[DataFrame], id_col: str, k: int = 60) -> DataFrame:
    """(id, score): reciprocal rank fusion of lists with a column rank."""
    parts = [x.select(id_col, (1.0 / (F.lit(k) + F.col("rank"))).alias("part")) for x in lists]
    return reduce(DataFrame.unionByName, parts).groupBy(id_col).agg(F.sum("part").alias("score"))


def hybrid(keyword: DataFrame, semantic: DataFrame, id_col: str, k: int) -> DataFrame:
    """(id, score, source): both lists cut at k and fused; if one is empty the other stands, with its scores.

    Which case holds is decided in the plan, from the k rows of either list.
    """
    a, b = top(keyword, k, id_col), top(semantic, k, id_col)
    tagged = a.withColumn("source", F.lit("keyword")).unionByName(b.withColumn("source", F.lit("semantic")))
    w = Window.partitionBy(F.lit(1))  # at most 2k rows
    both = (F.max(F.when(F.col("source") == "keyword", 1).otherwise(0)).over(w) + F.max(F.when(F.col("source") == "semantic", 1).otherwise(0)).over(w)) == 2
    rows = tagged.withColumn("both", both).withColumn("part", F.when(F.col("both"), 1.0 / (60 + F.col("rank"))).otherwise(F.col("score")))
    fused = rows.groupBy(id_col).agg(F.sum("part").alias("score"), F.max(F.when(F.col("both"), "hybrid").otherwise(F.col("source"))).alias("source"))
    return top(fused, k, id_col)


def search_projects(index: KeywordIndex, query: str, per_project: int, k: int) -> DataFrame:
    """Each project's best by its own statistics, then the best of all by raw score; `index` is kept by the project's column."""
    (project,) = index.by
    best = top(index.search(query), per_project, "id", by=[project]).drop("rank")
    return best.orderBy(F.col("score").desc(), project, "id").limit(k)


def relevant_hooks(hooks: DataFrame, query: str) -> DataFrame:
    """Hooks with a relevance above 0, the best first, then the oldest; a blank query passes all."""
    scored = hooks.withColumn("relevance", relevance(query, F.col("summary_title"), F.col("tags")))
    return scored if not query.strip() else scored.filter("relevance > 0").orderBy(F.col("relevance").desc(), "archived_at", "hook_id")


def expand_corpus(corpus: DataFrame, expansions: DataFrame, how: str, key: str = "session_id") -> DataFrame:
    """Corpus rows (key, item, at) with expansions (key, expansion, at) of their session.

    separate: as rows of their own; merge: each row once for each expansion,
    that and a blank before it; replace: the expansion in the row's place.
    Sessions without expansions stay as they are, but for separate.
    """
    told = expansions.filter("expansion is not null").select(key, "expansion", F.col("at").alias("__at"))
    if how == "separate":
        return corpus.select(key, "item", "at").unionByName(told.select(key, F.col("expansion").alias("item"), F.col("__at").alias("at")))
    if how not in ("merge", "replace"):
        raise ValueError("how must be separate, merge or replace")
    rows = corpus.select(key, "item", "at").join(told.drop("__at"), key, "left")
    new = F.col("expansion") if how == "replace" else F.concat("expansion", F.lit(" "), "item")
    return rows.select(key, F.when(F.col("expansion").isNotNull(), new).otherwise(F.col("item")).alias("item"), "at")


def split_expansions(expansions: DataFrame, by: str = ";") -> DataFrame:
    """One row for each part of an expansion between semicolons, or for each sentence; outer blanks do not count."""
    pattern = ";" if by == ";" else r"(?<=[.!?])\s+"
    return expansions.withColumn("expansion", F.explode(F.transform(F.split("expansion", pattern), lambda x: F.trim(x))))


class VectorTable:
    """Vectors kept as a table, a row an id: changes replace the rows of their ids, searches scan it."""

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "string"):
        self.spark, self.folder, self.schema = spark, folder, f"id {id_type}, vector array<float>, generation int"

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder) if exists(self.spark, self.folder) else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """(id, vector): the last of each id; a null vector was a removal."""
        last = self._rows().groupBy("id").agg(F.max_by(F.struct("vector"), "generation").alias("v"))
        return last.select("id", "v.vector").filter("vector is not null")

    def write(self, df: DataFrame, id_col: str, vector_col: str) -> VectorTable:
        """Adds vectors, each in place of that of its id; ids must differ within `df`."""
        last = self._rows().agg(F.max("generation")).first()[0]
        number = 0 if last is None else last + 1
        df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vector")).write.mode("overwrite").parquet(f"{self.folder}/generation={number}")
        return self

    def remove(self, ids: DataFrame) -> VectorTable:
        return self.write(ids.select("id").distinct().withColumn("vector", F.lit(None).cast("array<float>")), "id", "vector")

    def search(self, query: list[float]) -> DataFrame:
        return vector_scores(self.read(), "id", "vector", query)
