"""Reading, writing and looking up memories and hooks as tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import exists, materialize, remove_folder
from ..vocab import HIGH_VALUE_TAGS


def by_id(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.filter(F.col(key) == value)


def latest(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The last row of each key, by `order`; the aggregation starts before the shuffle, so hot keys cost one row a task."""
    row = F.struct(*(c for c in df.columns if c not in key))
    at = F.struct(*order, F.xxhash64(*df.columns))
    return df.groupBy(*key).agg(F.max_by(row, at).alias("__row")).select(*key, "__row.*")


def upsert(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `changes` in place of those of the same key."""
    return table.join(changes.select(*key), key, "left_anti").unionByName(changes)


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrites the partitions that `df` has rows for, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


class HookStore:
    """Index entries (hooks) as a table by scope, period and bucket of the session.

    An index document is all hooks of one scope, session and period; it is
    replaced as a whole, by an overwrite of the few partitions that hold it.
    A hook may stand in both scopes; within a scope its id is unique.
    """

    BY = ["scope", "period", "bucket"]
    DOCUMENT = ["scope", "session_id", "period"]

    def __init__(self, spark: SparkSession, path: str, schema, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.names = [f.name for f in schema]
        # partition columns stand last, as the files are read
        self.schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name not in self.BY) + ", scope string, period string, bucket int"

    def read(self, scope: str | None = None, period: str | None = None) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema).select(*self.names)
        rows = self._all()
        for name, value in (("scope", scope), ("period", period)):
            rows = rows if value is None else rows.filter(F.col(name) == value)
        return rows.select(*self.names)

    def _all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(self.buckets)).cast("int"))

    def _replace(self, touched: DataFrame, kept_of: Callable[[DataFrame], DataFrame], new: DataFrame | None) -> None:
        """Writes the partitions of `touched` (scope, period, bucket) anew: what `kept_of` keeps of them, and `new`."""
        parts = touched.select(*self.BY).distinct()
        rows = new
        if exists(self.spark, self.path):
            old = self._all().join(parts, self.BY, "left_semi")
            rows = kept_of(old) if new is None else kept_of(old).unionByName(new)
        if rows is None:
            return
        staged = materialize(rows, "hooks")
        full = staged.select(*self.BY).distinct()
        write_partitions(staged.hint("rebalance", *self.BY), self.path, self.BY)
        # partitions that lost their last row are not in the overwrite
        for r in parts.join(full, self.BY, "left_anti").collect():  # at most scopes x periods x buckets
            remove_folder(self.spark, f"{self.path}/scope={r['scope']}/period={r['period']}/bucket={r['bucket']}")

    def write(self, hooks: DataFrame) -> HookStore:
        """Replaces every document that `hooks` has rows of, as a whole."""
        new = self._bucketed(hooks.select(*self.names))
        documents = new.select(*self.DOCUMENT).distinct()
        self._replace(new, lambda old: _without_null_safe(old, documents, self.DOCUMENT), new)
        return self

    def delete(self, documents: DataFrame) -> HookStore:
        """Removes documents (scope, session_id, period); unknown ones have no effect."""
        keys = documents.select(*self.DOCUMENT).distinct()
        self._replace(self._bucketed(keys), lambda old: _without_null_safe(old, keys, self.DOCUMENT), None)
        return self

    def append(self, hooks: DataFrame) -> HookStore:
        """Adds hooks, each in place of one with its id and scope in the same document."""
        new = self._bucketed(latest(hooks.select(*self.names), ["hook_id", "scope"], ["archived_at"]).select(*self.names))
        keys = new.select("hook_id", *self.DOCUMENT)
        self._replace(new, lambda old: _without_null_safe(old, keys, ["hook_id", *self.DOCUMENT]), new)
        return self


def _without_null_safe(rows: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    other = keys.select(*(F.col(n).alias(f"__{n}") for n in names)).distinct()
    match = reduce(lambda x, y: x & y, (rows[n].eqNullSafe(other[f"__{n}"]) for n in names))
    return rows.join(other, match, "left_anti")


def list_memories(memories: DataFrame) -> DataFrame:
    """(session_id, period, n, memory_id): the memories of each session and period with their place by age and id; a memory written twice once."""
    rows = memories.groupBy("session_id", "period", "memory_id").agg(F.min("archived_at").alias("archived_at"))
    w = Window.partitionBy("session_id", "period").orderBy("archived_at", "memory_id")
    return rows.select("session_id", "period", F.row_number().over(w).alias("n"), "memory_id")


def linked_memories(memories: DataFrame, link: str, owner: str) -> DataFrame:
    """(owner, memory_id, n): memories of one kind of link (standalone ones of a session, linked ones of a project) with their place by age and id."""
    w = Window.partitionBy(owner).orderBy("archived_at", "memory_id")
    rows = memories.filter((F.col("link") == link) & F.col(owner).isNotNull()).select(owner, "memory_id", "archived_at").distinct()
    return rows.withColumn("n", F.row_number().over(w)).drop("archived_at")


def put_contexts(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Raw contexts (session_id, hook_id, text, at) with the changes, the last of each key; a null text deletes."""
    rows = latest(table.unionByName(changes), ["session_id", "hook_id"], ["at"])
    return rows.filter("text is not null")


def without(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Hard delete."""
    return table.join(keys.select(key).distinct(), key, "left_anti")


def mark_deleted(hooks: DataFrame, keys: DataFrame, key: str = "memory_id") -> DataFrame:
    """Soft delete: hooks of the keys become deleted, the others stay; unknown keys have no effect."""
    gone = keys.select(key).distinct().withColumn("__gone", F.lit(True))
    return hooks.join(gone, key, "left").withColumn("file_status", F.when(F.col("__gone"), "deleted").otherwise(F.col("file_status"))).drop("__gone")


def not_deleted(hooks: DataFrame) -> DataFrame:
    return hooks.filter("file_status is null or file_status <> 'deleted'")


def batch_lookup(requested: DataFrame, table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Every requested key with its row's columns and success; a key that is not there fails alone."""
    found = table.select(key, *columns).dropDuplicates([key]).withColumn("success", F.lit(True))
    return requested.join(found, key, "left").withColumn("success", F.coalesce("success", F.lit(False)))


def batch_delete(requested: DataFrame, table: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rest, results): the table without the requested keys, and each key with success; a key that is not there fails alone."""
    return without(table, requested, key), batch_lookup(requested.select(key).distinct(), table, key, [])


def batch_update(changes: DataFrame, table: DataFrame, key: str, least: int = 0, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """(table, results): importance set, within 0 to 100, where a change (key, importance) names a row; each change with success.

    A null importance changes nothing and succeeds if the row is there. Of several changes of a key the greatest holds.
    """
    asked = changes.groupBy(key).agg(F.max("importance").alias("__importance"))
    bound = F.least(F.greatest("__importance", F.lit(least)), F.lit(most))
    done = table.join(asked, key, "left").withColumn("importance", F.coalesce(F.when(F.col("__importance").isNotNull(), bound), "importance")).drop("__importance")
    return done, batch_lookup(changes.select(key).distinct(), table, key, [])


def batch_summary(looked_up: DataFrame) -> DataFrame:
    return looked_up.agg(F.count("*").alias("total"), F.count_if("success").alias("success_count"))


def find_by_prefix(hooks: DataFrame, prefix: str, least: int = 4, scopes: tuple[str, ...] = ("session", "project")) -> DataFrame:
    """Hooks whose id is, or from `least` characters on begins with, the prefix; exact ones first, then the oldest, each id once.

    Of an id in several scopes the first of `scopes` counts. Deleted hooks are left out.
    """
    exact = F.col("hook_id") == prefix
    match = exact | F.col("hook_id").startswith(prefix) if len(prefix) >= least else exact
    rank = F.array_position(F.array(*map(F.lit, scopes)), F.col("scope"))
    rows = not_deleted(hooks).filter(match & (rank > 0))
    one = rows.groupBy("hook_id").agg(F.min(F.struct(rank.alias("rank"), "archived_at", "memory_id", "scope")).alias("h")).select("hook_id", "h.archived_at", "h.memory_id", "h.scope")
    return one.orderBy((F.col("hook_id") == prefix).desc(), "archived_at", "hook_id")


def resolve_prefix(hooks: DataFrame, prefix: str, least: int = 4) -> DataFrame:
    """(status, hook_id, candidates) of one lookup: found, deleted, unknown or ambiguous, then with up to five candidates by id."""
    exact = hooks.filter(F.col("hook_id") == prefix)
    alive = find_by_prefix(hooks, prefix, least)
    five = alive.limit(5).agg(F.array_sort(F.collect_list("hook_id")).alias("five"))  # at most five ids
    facts = alive.agg(F.count("*").alias("n"), F.max(F.when(F.col("hook_id") == prefix, 1)).alias("same")).crossJoin(five).crossJoin(exact.agg(F.count("*").alias("there")))
    found = (F.col("same") == 1) | ((F.col("there") == 0) & (F.col("n") == 1))
    status = F.when(found, "found").when(F.col("there") > 0, "deleted").when(F.col("n") == 0, "unknown").otherwise("ambiguous")
    rows = facts.withColumn("status", status)
    return rows.select("status", F.when(found, F.when(F.col("same") == 1, F.lit(prefix)).otherwise(F.col("five")[0])).alias("hook_id"), F.when(F.col("status") == "ambiguous", F.col("five")).alias("candidates"))


def recent_hooks(hooks: DataFrame, n: int, key: str | None = None) -> DataFrame:
    """The n latest hooks in order of age (of each key, if given); 0 means all."""
    if key:
        w = Window.partitionBy(key).orderBy(F.col("archived_at").desc(), F.col("hook_id").desc())
        return hooks if not n else hooks.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")
    rows = hooks.orderBy(F.col("archived_at").desc(), F.col("hook_id").desc())
    return (rows.limit(n) if n else rows).orderBy("archived_at", "hook_id")


def summary_view(hooks: DataFrame) -> DataFrame:
    """A row of presentation for each hook that is not deleted."""
    return not_deleted(hooks).select(
        "hook_id", "memory_id", "period", "scope", "summary_title",
        F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ", ").alias("tag_names"),
        F.date_format("archived_at", "yyyy-MM-dd'T'HH:mm:ss").alias("archived"),
        "token_count",
    )


def with_memory_text(hooks: DataFrame, memories: DataFrame) -> DataFrame:
    """Hooks with the text of their memory, empty where there is none; a memory written twice counts once."""
    texts = memories.groupBy("memory_id").agg(F.max_by("content", F.struct("received_at", F.xxhash64("content"))).alias("content"))
    return hooks.join(texts, "memory_id", "left").withColumn("content", F.coalesce("content", F.lit("")))


def index_text(rows: DataFrame) -> DataFrame:
    """Title, abstract, facts, entities, tags and content (what was said) joined by ` | `, blank parts left out; of the middle ones only the columns that are there."""
    there = set(rows.columns)
    words = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ")
    parts = [F.col("summary_title")] + [F.col("abstract")] * ("abstract" in there) + [words(c) for c in ("key_facts", "key_entities") if c in there]
    parts += [words("tags"), F.col("content")]
    return rows.withColumn("index_text", F.concat_ws(" | ", *(F.when(F.trim(p) != "", p) for p in parts)))


def expands(hooks: DataFrame) -> Column:
    """A prompt tells a hook at length: daily ones with a high-value tag and facts, weekly ones that are rich (facts, entities or an abstract), monthly ones always."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    high = F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, HIGH_VALUE_TAGS))), F.lit(False))
    rich = some("key_facts") | some("key_entities") | F.coalesce(F.trim("abstract") != "", F.lit(False))
    return F.when(F.col("period") == "daily", high & some("key_facts")).when(F.col("period") == "weekly", rich).otherwise(F.col("period") == "monthly")


def prompt_entry(hooks: DataFrame) -> DataFrame:
    """Adds entry: the lines a prompt has for a hook, title with tags and tokens, its id, and what `expands` tells of abstract and facts."""
    none = F.array().cast("array<string>")
    names = F.array_join(F.coalesce("tags", none), ", ")
    head = F.concat(F.lit("- **"), F.coalesce("summary_title", F.lit("")), F.lit("**"), F.when(names != "", F.concat(F.lit(" ["), names, F.lit("]"))).otherwise(F.lit("")), F.lit(" ("), F.coalesce("token_count", F.lit(0)), F.lit(" tokens)"))
    facts = F.transform(F.coalesce("key_facts", none), lambda x: F.concat(F.lit("    - "), x))
    more = F.concat(
        F.when(F.col("abstract").isNotNull(), F.array(F.concat(F.lit("  - abstract: "), "abstract"))).otherwise(none), F.when(F.size(facts) > 0, F.concat(F.array(F.lit("  - facts:")), facts)).otherwise(none)
    )
    lines = F.concat(F.array(head, F.concat(F.lit("  - id: `"), "hook_id", F.lit("`"))), F.when(F.coalesce(expands(hooks), F.lit(False)), more).otherwise(none))
    return hooks.withColumn("entry", F.array_join(lines, "\n"))


def with_snapshot(prompts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Prompts (session_id, prompt) with what the session was last doing: the latest of snapshots (session_id, at, task, next_step)."""
    last = latest(snapshots.select("session_id", "at", "task", "next_step"), ["session_id"], ["at"])
    told = F.concat(F.lit("\ncurrent task: "), F.coalesce("task", F.lit("?")), F.coalesce(F.concat(F.lit("\nnext step: "), F.col("next_step")), F.lit("")))
    rows = prompts.join(last, "session_id", "left")
    return rows.withColumn("prompt", F.concat("prompt", F.when(F.col("at").isNotNull(), told).otherwise(F.lit("")))).drop("at", "task", "next_step")


def prompt_lines(hooks: DataFrame, ranked: Column | None = None, most: int = 15) -> DataFrame:
    """(session_id, period, lines, prompt): the last `most` hooks of a session and period by age, or by `ranked` first.

    A hook's line is its column entry (see prompt_entry), else its title and id.
    Hooks beyond `most` fall away within the tasks that read them, so no prompt
    gathers more than that. Ranked hooks with equal marks stand by age.
    """
    own = F.col("entry") if "entry" in hooks.columns else None
    rows = not_deleted(hooks).withColumn("__line", own if own is not None else F.concat(F.lit("- "), F.coalesce("summary_title", F.lit("?")), F.lit(" ["), "hook_id", F.lit("]")))
    late = Window.partitionBy("session_id", "period").orderBy(F.col("archived_at").desc(), F.col("hook_id").desc(), F.col("__line").desc())
    near = rows.withColumn("__n", F.row_number().over(late)).filter(F.col("__n") <= most)
    order = F.struct(*([(-ranked).alias("r")] if ranked is not None else []), "archived_at", "hook_id", F.col("__line").alias("line"))
    return near.groupBy("session_id", "period").agg(
        F.count("*").alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["line"]), "\n").alias("prompt")
    )


def threshold_advice(tokens: Column, threshold: int) -> Column:
    share = F.floor(tokens * 100.0 / threshold + 0.5)
    return F.when(share >= 100, "archive").when(share >= 80, "soon").otherwise("wait")


def access_counts(log: DataFrame, key: str = "memory_id") -> DataFrame:
    return log.groupBy(key).agg(F.count("*").alias("accesses"))
