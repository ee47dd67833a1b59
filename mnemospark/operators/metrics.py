"""Measures of retrieval and of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stems import stems
from ..functions.text import normalise_answer
from . import sequences


def retrieval_metrics(ranked: DataFrame, answers: DataFrame, query: str, item: str, ks: list[int]) -> DataFrame:
    """(query, k, recall_any, recall_all, ndcg) for each k, of ranked (query, item, rank from 1) and answers (query, item).

    The gain of position i, from 1, is divided by log2(i), that of the first by
    1; ideal are the answers first. A query without answers has recall_all 1 and
    ndcg 0. Nothing is gathered: only the ranks up to the largest k are joined,
    all else is sums. Answers count once.
    """
    ask = answers.select(query, item).distinct()
    wanted = ask.groupBy(query).agg(F.count("*").alias("wanted"))
    near = ranked.filter(F.col("rank") <= max(ks)).join(ask.withColumn("hit", F.lit(1)), [query, item], "left")
    gain = F.when(F.col("rank") <= 1, F.lit(1.0)).otherwise(1.0 / F.log2(F.col("rank").cast("double")))
    at = lambda k, x: F.sum(F.when((F.col("rank") <= k) & (F.col("hit") == 1), x).otherwise(F.lit(0.0)))
    sums = near.groupBy(query).agg(*(F.struct(F.lit(k).alias("k"), at(k, F.lit(1.0)).alias("hits"), at(k, gain).alias("dcg")).alias(f"k{k}") for k in ks))
    rows = sums.select(query, F.explode(F.array(*(f"k{k}" for k in ks))).alias("m")).join(wanted, query, "left").withColumn("wanted", F.coalesce("wanted", F.lit(0)))
    most = F.least("wanted", F.col("m.k"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + F.when(i <= 1, F.lit(1.0)).otherwise(1.0 / F.log2(i.cast("double"))))
    return rows.select(
        query,
        "m.k",
        (F.col("m.hits") > 0).cast("double").alias("recall_any"),
        (F.col("m.hits") == F.col("wanted")).cast("double").alias("recall_all"),
        F.when(F.col("wanted") > 0, F.col("m.dcg") / ideal).otherwise(F.lit(0.0)).alias("ndcg"),
    )


def first_sessions(ranked: DataFrame, query: str, session: str, k: int) -> DataFrame:
    """(query, session, rank): the first k different sessions of a ranking of their turns, each at the place of its best turn.

    However far down the k-th session stands, the ranking is followed to it.
    """
    best = ranked.groupBy(query, session).agg(F.min("rank").alias("__best"))
    w = Window.partitionBy(query).orderBy("__best", session)
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("__best")


def answer_words(text: Column) -> Column:
    """The words of a normalised answer."""
    return F.filter(F.split(normalise_answer(text), " "), lambda w: w != "")


def token_f1(prediction: Column, truth: Column) -> Column:
    """F1 of the multisets of normalised words."""
    return words_f1(answer_words(prediction), answer_words(truth))


def with_stemmed_f1(df: DataFrame, prediction: str, truth: str, name: str = "f1") -> DataFrame:
    """Adds the F1 of the multisets of the stems of normalised words."""
    rows = df.withColumns({"__p": stems(answer_words(F.col(prediction))), "__t": stems(answer_words(F.col(truth)))})
    return rows.withColumn(name, words_f1(F.col("__p"), F.col("__t"))).drop("__p", "__t")


def words_f1(p: Column, t: Column) -> Column:
    """F1 of two multisets of words."""
    count = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    same = F.aggregate(F.transform(F.array_distinct(p), lambda w: F.least(count(p, w), count(t, w))), F.lit(0), lambda s, x: s + x)
    return F.when(same > 0, 2.0 * same / (F.size(p) + F.size(t))).otherwise(F.lit(0.0))


def exact_match(prediction: Column, truth: Column) -> Column:
    words = lambda x: F.array_sort(F.array_distinct(F.split(normalise_answer(x), " ")))
    return words(prediction) == words(truth)


def multi_f1(prediction: Column, truth: Column) -> Column:
    """Mean over the comma-separated right answers of the best F1 among the comma-separated predictions."""
    parts = lambda x: F.transform(F.split(x, ","), lambda s: F.trim(s))
    best = F.transform(parts(truth), lambda t: F.array_max(F.transform(parts(prediction), lambda p: token_f1(p, t))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(best)


def category_score(category: Column, prediction: Column, truth: Column) -> Column:
    """1: several answers; 2 and 4: one; 3: what stands before a semicolon; 5: says that nothing is known."""
    silent = F.lower(prediction).contains("no information available") | F.lower(prediction).contains("not mentioned")
    return (
        F.when(category == 1, multi_f1(prediction, truth))
        .when(category == 3, token_f1(prediction, F.trim(F.split(truth, ";")[0])))
        .when(category.isin(2, 4), token_f1(prediction, truth))
        .when(category == 5, silent.cast("double"))
        .otherwise(F.lit(0.0))
    )


def evidence_recall(evidence: Column, found: Column) -> Column:
    hits = F.size(F.filter(evidence, lambda x: F.array_contains(found, x)))
    return F.when(F.size(evidence) > 0, hits / F.size(evidence)).otherwise(F.lit(1.0))


def accuracy(df: DataFrame, value: str, outer: list[str], inner: str) -> DataFrame:
    """Mean (four digits) and number by all the keys, and by the outer ones alone, where `inner` is null."""
    cube = df.groupingSets([[*outer, inner], outer], *outer, inner)
    return cube.agg(F.round(F.avg(value), 4).alias("mean"), F.count(value).alias("n"))


def distance_buckets(df: DataFrame, key: str, order: list[str], length: str, width: int = 1000) -> DataFrame:
    """Adds the bucket of each row's distance, the lengths of the rows of its key up to it."""
    rows = sequences.running_sum(sequences.stretches(df, key, order), key, order, F.col(length), "distance")
    return rows.withColumn("bucket", F.ceil(F.col("distance") / width)).drop(sequences.PART)


def accuracy_by_distance(df: DataFrame, category: str, correct: str) -> DataFrame:
    """(category, bucket, asked, accuracy): share of right answers by category and distance bucket; `df` as from distance_buckets."""
    return df.groupBy(category, "bucket").agg(F.count("*").alias("asked"), F.round(F.avg(F.col(correct).cast("double")), 6).alias("accuracy"))


def stratified_sample(df: DataFrame, stratum: str, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, or all if there are fewer: max(1, n / strata) of each stratum, filled up from the others or cut to n.

    A row's place is that of a hash of id and seed, so the sample is one and the
    same for any partitioning. Strata are counted on the driver's side as one row.
    """
    pick = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))
    rows = df.withColumn("__pick", pick)
    strata = df.select(stratum).distinct().count()
    each = max(1, n // max(strata, 1))
    w = Window.partitionBy(stratum).orderBy("__pick", id_col)
    chosen = rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= each)  # cut within the tasks first
    rest = rows.join(chosen.select(id_col), id_col, "left_anti").orderBy("__pick", id_col).limit(n)
    both = chosen.drop("__n").withColumn("__late", F.lit(0)).unionByName(rest.withColumn("__late", F.lit(1)))
    return both.orderBy("__late", "__pick", id_col).limit(n).drop("__late", "__pick")


def date_range_rerank(ranked: DataFrame, dates: DataFrame, ranges: DataFrame, margin_days: int = 2) -> DataFrame:
    """Of each question, moves sessions with a date within the margin of its range ahead, else in the order they had.

    ranked: (question, session_id, rank); dates: (session_id, day); ranges:
    (question, start, end). A question without range keeps its order.
    """
    wide = ranges.select("question", F.date_sub("start", margin_days).alias("low"), F.date_add("end", margin_days).alias("high"))
    named = ranked.join(wide, "question", "left")
    inside = named.select("question", "session_id", "low", "high").join(dates, "session_id").filter(F.col("day").between(F.col("low"), F.col("high")))
    inside = inside.select("question", "session_id").distinct().withColumn("in_range", F.lit(True))
    rows = ranked.join(inside, ["question", "session_id"], "left").withColumn("in_range", F.coalesce("in_range", F.lit(False)))
    return rows.withColumn("new_rank", F.row_number().over(Window.partitionBy("question").orderBy(F.col("in_range").desc(), "rank", "session_id")))
