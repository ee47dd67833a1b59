"""Contradictions among the facts of a memory's updates.

facts: (memory_id, update_seq, kind, fact) with kind added, revised or deprecated.
Facts meet within one memory only, so the joins are on its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fact_similarity, opposes, word_similarity
from ..functions.vectors import dot


def _pairs(facts: DataFrame, new_kind: str, earlier: bool) -> DataFrame:
    new = facts.filter(F.col("kind") == new_kind).select("memory_id", F.col("update_seq").alias("seq"), F.col("fact").alias("new_fact"))
    old_kind = "added" if earlier else "deprecated"
    old = facts.filter(F.col("kind") == old_kind).select("memory_id", F.col("update_seq").alias("old_seq"), F.col("fact").alias("existing_fact"))
    rows = new.join(old, "memory_id")
    return rows.filter(F.col("old_seq") < F.col("seq")) if earlier else rows.filter(F.col("old_seq") == F.col("seq"))


def self_contradictions(facts: DataFrame, threshold: float = 0.8) -> DataFrame:
    """An added fact is like one that the same update deprecates."""
    return _pairs(facts, "added", False).filter(fact_similarity("new_fact", "existing_fact") >= threshold).withColumn("conflict", F.lit("self"))


def direct_contradictions(facts: DataFrame) -> DataFrame:
    """An added fact says the opposite of one added earlier."""
    return _pairs(facts, "added", True).filter(opposes("new_fact", "existing_fact")).withColumn("conflict", F.lit("direct"))


def stance_reversals(facts: DataFrame, threshold: float = 0.6) -> DataFrame:
    """A deprecated fact is like one added earlier."""
    return _pairs(facts, "deprecated", True).filter(fact_similarity("new_fact", "existing_fact") >= threshold).withColumn("conflict", F.lit("reversal"))


def detect(facts: DataFrame) -> DataFrame:
    """(memory_id, seq, conflict, new_fact, existing_fact, severity, description)."""
    found = self_contradictions(facts).unionByName(direct_contradictions(facts)).unionByName(stance_reversals(facts))
    severity = F.when(F.col("conflict") == "direct", "critical").otherwise("warning")
    description = F.concat_ws(" ", F.col("conflict"), F.lit("of"), "new_fact", F.lit("and"), "existing_fact")
    return found.select("memory_id", "seq", "conflict", "new_fact", "existing_fact", severity.alias("severity"), description.alias("description"))


def summary(conflicts: DataFrame) -> DataFrame:
    critical = F.col("severity") == "critical"
    return conflicts.groupBy("memory_id").agg(F.count("*").alias("conflicts"), F.count_if(critical).alias("critical"), F.bool_or(critical).alias("has_critical"))


_REPORT = ["memory_id", "seq", "conflict", "new_fact", "existing_fact", "severity", "description"]
_SEVERITIES = ("info", "warning", "critical")


def merge_reports(heuristic: DataFrame, other: DataFrame, threshold: float = 0.7, similarity=fact_similarity) -> DataFrame:
    """Both reports without what the second repeats; columns as from detect.

    A row of the second goes into the first one of the same memory and kind with
    the same new fact, or one of a similarity of at least `threshold`: the
    graver severity and the longer description stay, the existing fact is that
    of the second where it has one. What matches nothing is appended.
    """
    grave = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, _SEVERITIES)), c), F.lit(0))
    own = ["memory_id", "conflict", "seq", "new_fact", "existing_fact"]
    h = heuristic.select(*_REPORT).distinct()
    o = other.select(*_REPORT).distinct().withColumn("__id", F.xxhash64(*_REPORT))
    asked = o.select("memory_id", "conflict", "__id", *(F.col(c).alias(f"o_{c}") for c in ("seq", "new_fact", "existing_fact", "severity", "description")))
    same = (F.col("new_fact") == F.col("o_new_fact")) | (similarity("new_fact", "o_new_fact") >= threshold)
    first = asked.join(h.select(*own), ["memory_id", "conflict"]).filter(same)
    first = first.groupBy("memory_id", "conflict", "__id", "o_seq", "o_existing_fact", "o_severity", "o_description").agg(F.min(F.struct("seq", "new_fact", "existing_fact")).alias("m"))
    late = F.when(F.col("o_existing_fact").isNotNull(), F.struct("o_seq", "o_existing_fact"))
    merged = first.groupBy("memory_id", "conflict", "m.seq", "m.new_fact", "m.existing_fact").agg(
        F.max(grave(F.col("o_severity"))).alias("o_grave"),
        F.max(F.struct(F.length("o_description"), "o_description")).alias("o_long"),
        F.max(late).alias("o_late"),
    )
    level = F.greatest(grave(F.col("severity")), F.coalesce("o_grave", F.lit(0)))
    longer = F.length("o_long.o_description") > F.length("description")
    match = [h[c].eqNullSafe(merged[c]) for c in own]
    kept = h.join(merged, match, "left").select(
        *(h[c] for c in own[:-1]),
        F.coalesce("o_late.o_existing_fact", h["existing_fact"]).alias("existing_fact"),
        F.element_at(F.array(*map(F.lit, _SEVERITIES)), F.greatest(level, F.lit(1)).cast("int")).alias("severity"),
        F.when(longer, F.col("o_long.o_description")).otherwise(F.col("description")).alias("description"),
    )
    rest = o.join(first.select("__id"), "__id", "left_anti")
    return kept.select(*_REPORT).unionByName(rest.select(*_REPORT))


def embedding_similarity(pairs: DataFrame, vectors: DataFrame, a: str, b: str) -> DataFrame:
    """Adds similarity: the cosine of the embeddings of the facts `a` and `b`, where one is missing that of their words.

    vectors: (fact, vector), a fact once. Zero vectors and vectors of different lengths have cosine 0.
    """
    side = lambda c: vectors.select(F.col("fact").alias(c), F.col("vector").alias(f"__{c}"))
    rows = pairs.join(side(a), a, "left").join(side(b), b, "left")
    u, v = F.col(f"__{a}"), F.col(f"__{b}")
    norms = F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))
    cosine = F.when((F.size(u) == F.size(v)) & (norms > 0), dot(u, v) / norms).otherwise(F.lit(0.0))
    both = u.isNotNull() & v.isNotNull()
    return rows.withColumn("similarity", F.when(both, cosine).otherwise(word_similarity(a, b))).drop(f"__{a}", f"__{b}")
