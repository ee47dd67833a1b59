"""Scores, weekly merging and monthly eviction of memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_chitchat, week_key
from ..vocab import PRIORITY_TAGS, SCENARIO_WORDS, SCENARIOS
from .turns import is_high_value


def decay(age_days: Column, half_life: float = 7.0) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life)


def eviction_score(archived_at: Column, access_count: Column, importance: Column, now: str, weights: tuple[float, ...] | None = None, topic: Column | None = None) -> Column:
    """100 for the most worth keeping: recency by half-life of 7 days, accesses up to 10, importance; topic 50 unless given."""
    recency, access, relevance, mark = weights or (1 / 3, 1 / 3, 0.0, 1 / 3)
    age = (F.lit(now).cast("timestamp").cast("double") - archived_at.cast("double")) / 86400
    score = (
        F.lit(recency) * 100 * decay(age)
        + F.lit(access) * F.least(F.coalesce(access_count, F.lit(0)) / 10.0, F.lit(1.0)) * 100
        + F.lit(relevance) * (F.lit(50.0) if topic is None else topic)
        + F.lit(mark) * F.coalesce(importance, F.lit(0))
    )
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0))


def scenario_score(scenario: str, archived_at: Column, access_count: Column, importance: Column, now: str) -> Column:
    weights = SCENARIOS[scenario][1:]
    if abs(sum(weights) - 1) > 0.01:
        raise ValueError("weights must add up to 1")
    return eviction_score(archived_at, access_count, importance, now, weights)


def tag_priority(tag: Column, scenario: str) -> Column:
    """1 for the first tag of the scenario's list, less for later ones, 0 for others."""
    tags = PRIORITY_TAGS.get(scenario, [])
    if not tags:
        return F.lit(0.0)
    at = F.array_position(F.array(*(F.lit(t) for t in tags)), tag)
    return F.when(at > 0, 1 - (at - 1) / F.lit(float(len(tags)))).otherwise(F.lit(0.0))


def resolve_threshold(user: Column, scenario: Column, model: Column, window: Column, default: int = 400_000) -> Column:
    """The user's threshold, else the scenario's, the model's or the default, these up to 80 % of the model's window."""
    ceiling = F.when(window.isNotNull(), F.floor(window * 0.8))
    return F.coalesce(user, F.least(F.coalesce(scenario, model, F.lit(default)), ceiling)).cast("long")


def weekly_merge(turns: DataFrame, by_week: bool = True) -> DataFrame:
    """(session_id[, week], turns, tokens, tags): all turns but chit-chat, merged by session and ISO week."""
    kept = turns.filter(~is_chitchat("user_text", "llm_text"))
    keys = ["session_id", *(["week"] if by_week else [])]
    kept = kept.withColumn("week", week_key("created_at")) if by_week else kept
    return kept.groupBy(*keys).agg(
        F.count("*").alias("turns"),
        F.sum("tokens").alias("tokens"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))), ",").alias("tags"),
    )


def monthly_evict(files: DataFrame, keys: list[str]) -> DataFrame:
    """Adds is_main: of each key the file with the highest score (then the least id); `score` as of eviction_score."""
    best = files.groupBy(*keys).agg(F.max("score").alias("top"))
    main = files.join(best.select(*keys, "top"), keys).filter("score = top").groupBy(*keys).agg(F.min("memory_id").alias("main"))
    return files.join(main, keys).withColumn("is_main", F.col("memory_id") == F.col("main"))


def weekly_hooks(hooks: DataFrame, keys: list[str]) -> DataFrame:
    """Daily hooks as those of the merged memory of their keys: pointed at it, with one summary for all.

    Title: how many were merged; abstract: their titles; key_facts: the titles,
    key_entities: the different tags, first seen first, by age and id. The
    summary is one value a key, of as many titles as it has daily hooks.
    """
    one = hooks.select(*keys, F.struct("archived_at", "hook_id", F.coalesce("summary_title", F.lit("")).alias("title"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags")).alias("h"))
    told = one.groupBy(*keys).agg(F.array_sort(F.collect_list("h")).alias("h"))
    titles = F.transform("h", lambda x: x["title"])
    summary = told.select(
        *keys,
        F.concat(F.lit("Weekly merge ("), F.size("h"), F.lit(" memories)")).alias("summary_title"),
        F.concat(F.lit("Merged "), F.size("h"), F.lit(" daily memories: "), F.array_join(titles, "; ")).alias("abstract"),
        titles.alias("key_facts"),
        F.array_distinct(F.flatten(F.transform("h", lambda x: x["tags"]))).alias("key_entities"),
    )
    named = F.concat_ws("/", F.lit("weekly"), *keys)
    return hooks.drop("summary_title").join(summary, keys).withColumns({"memory_id": named, "period": F.lit("weekly")})


def merged_months(turns: DataFrame, evicted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, main, turns, added, tokens, tags) of each monthly memory: all turns of the main file and the high-value ones of the others.

    turns: memory_id, turn_id, tokens, tags; evicted: as from monthly_evict.
    """
    kept = kept_turns(turns, evicted.select(*keys, "memory_id", "main", "is_main", "score"))
    return kept.groupBy(*keys, "main").agg(
        F.count("*").alias("turns"), F.count_if(~F.col("is_main")).alias("added"), F.sum("tokens").alias("tokens"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))), ",").alias("tags"),
    )


def kept_turns(turns: DataFrame, evicted: DataFrame) -> DataFrame:
    """Turns of main files, and high-value turns of all others, each with its file's main one."""
    rows = turns.join(evicted, "memory_id")
    return rows.filter(F.col("is_main") | is_high_value(F.col("tags")))


def scenario_hits(turns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, scenario, hits): the number of different words of each scenario that any of the texts holds; only where there are some."""
    text = F.lower(F.concat(F.coalesce("user_text", F.lit("")), F.lit(" "), F.coalesce("llm_text", F.lit("")), F.lit(" ")))
    rows = turns.select(*keys, text.alias("text"))
    words = [(s, i, w) for s, ws in SCENARIO_WORDS.items() for i, w in enumerate(ws)]
    any_of = rows.groupBy(*keys).agg(*(F.max(F.contains("text", F.lit(w))).alias(f"{s}_{i}") for s, i, w in words))
    hits = F.array(*(F.struct(F.lit(s).alias("scenario"), sum((F.col(f"{s}_{i}").cast("int") for i in range(len(ws))), F.lit(0)).alias("hits")) for s, ws in SCENARIO_WORDS.items()))
    return any_of.select(*keys, F.explode(hits).alias("h")).select(*keys, "h.scenario", "h.hits").filter("hits > 0")


def detect_scenario(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, scenario, confidence): the scenario with most hits, the first of the list if several; confidence is its share of its own and the second's hits."""
    order = {s: i for i, s in enumerate(SCENARIO_WORDS)}
    place = F.element_at(F.create_map(*(F.lit(x) for kv in order.items() for x in kv)), F.col("scenario"))
    w = Window.partitionBy(*keys).orderBy(F.col("hits").desc(), place)
    two = hits.withColumn("n", F.row_number().over(w)).filter("n <= 2")
    best = two.groupBy(*keys).agg(F.max(F.when(F.col("n") == 1, F.col("scenario"))).alias("scenario"), F.max(F.when(F.col("n") == 1, F.col("hits"))).alias("a"), F.max(F.when(F.col("n") == 2, F.col("hits"))).alias("b"))
    return best.select(*keys, "scenario", (F.col("a") / (F.col("a") + F.coalesce("b", F.lit(0)))).alias("confidence"))


def resolve_scenario(user: Column, stored: Column, detected: Column, confidence: Column, default: str = "coding", least: float = 0.6) -> Column:
    """The user's scenario, else the stored one, the detected one if confident enough, or the default."""
    return F.coalesce(user, stored, F.when(confidence >= least, detected), F.lit(default))


def priority_bucket(tokens: Column) -> Column:
    return F.when(tokens > 1000, "high").when(tokens > 500, "medium").otherwise("low")


def inject_strategy(score: Column) -> Column:
    return F.when(score > 0.7, "full").when(score > 0.4, "summary").otherwise("keywords")


def retained(turns: DataFrame, least_tokens: int = 100, n: int = 10) -> DataFrame:
    """The first n turns of each session with more than so many tokens."""
    w = Window.partitionBy("session_id").orderBy("created_at", "turn_id")
    return turns.filter(F.col("tokens") > least_tokens).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= n)
