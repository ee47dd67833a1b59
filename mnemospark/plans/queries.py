"""Queries over the test tables, one for each operator, and the SQL they must agree with."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import conflicts, increments, keyword, lifecycle, metrics, search, storage, turns
from ..session import exists, load, move, new_folder, shared_folder, version
from ..sources import context, documents, packed
from ..streaming import totals
from ..streaming.deliveries import repeated_deliveries
from ..vocab import SCENARIO_WORDS, TOKENIZER_FACTORS
from . import sqltext as q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NOW = "2026-01-01 00:00:00"
SEARCHED = "retry window 缓存层 snapshot retry"
SEARCHED_TERMS = {"retry": 2, "window": 1, "缓": 1, "存": 1, "层": 1, "snapshot": 1}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    """One row a message id with role and payload: (id, session_id, seq, role, text, tokens, finish, cost, received_at)."""
    rows = load(spark, folder, "session_messages").filter("session_id is not null and seq is not null")
    one = storage.latest(rows.select("id", "session_id", "seq", "type", "data", "received_at"), ["id"], ["received_at"])
    parsed = one.withColumn("v", F.expr("try_parse_json(data)"))
    text = context.payload_text("v")
    return parsed.select(
        "id", "session_id", "seq", F.lower(F.trim("type")).alias("role"), text.alias("text"),
        F.coalesce(context.payload_tokens("v"), tx.estimate_tokens(text)).alias("tokens"),
        context.payload_finish("v").alias("finish"), context.payload_cost("v").alias("cost"), "received_at",
    )


# The same rows in SQL; damaged data has no text on either side.
_MESSAGES = f"""
parsed AS (
  SELECT id, session_id, seq, lower(trim(type, ' ')) AS role, CASE WHEN json_valid(data) THEN data END AS j,
    coalesce(CASE WHEN json_valid(data) THEN coalesce(data->>'$.text', CASE WHEN json_type(data->'$.content') = 'ARRAY' THEN
      array_to_string(list_transform(list_filter(CAST(data->'$.content' AS JSON[]), lambda p: p->>'$.type' = 'text' AND p->>'$.text' IS NOT NULL), lambda p: p->>'$.text'), chr(10)) END) END, '') AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at DESC) AS n FROM session_messages WHERE session_id IS NOT NULL AND seq IS NOT NULL)
  WHERE n = 1
), messages AS (
  SELECT id, session_id, seq, role, text, {q.tokens('text')} AS tokens, j->>'$.finish' AS finish, CAST(j->>'$.cost' AS DOUBLE) AS cost FROM parsed
)"""


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    """The last row of each turn with its tokens and tags."""
    rows = storage.latest(load(spark, folder, "sidecar_turns").filter("turn_id is not null"), ["turn_id"], ["received_at"])
    return rows.withColumns({"tokens": turns.turn_tokens(), "tags": turns.turn_tags()})


_LATEST_TURNS = "t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY received_at DESC) AS n FROM sidecar_turns WHERE turn_id IS NOT NULL) WHERE n = 1)"
_TURNS = f"WITH {_LATEST_TURNS}, turns AS (SELECT *, {q.turn_tokens()} AS tokens, {q.turn_tags()} AS tags FROM t)"


# Scalars over texts


@query(f"SELECT doc_id, {q.tokens('text')} AS tokens FROM documents")
def scalar_token_estimate(spark, folder):
    return load(spark, folder, "documents").select("doc_id", tx.estimate_tokens("text").alias("tokens"))


@query(f"SELECT doc_id, {q.char_tokens('text')} AS tokens FROM documents")
def scalar_char_tokens(spark, folder):
    return load(spark, folder, "documents").select("doc_id", tx.char_tokens("text").alias("tokens"))


@query(f"SELECT hook_id, scope, {q.language('summary_title')} AS language, round({q.cjk_ratio('summary_title')}, 6) AS ratio FROM hooks WHERE summary_title IS NOT NULL")
def scalar_language(spark, folder):
    rows = load(spark, folder, "hooks").filter("summary_title is not null")
    return rows.select("hook_id", "scope", tx.text_language("summary_title").alias("language"), F.round(tx.cjk_ratio("summary_title"), 6).alias("ratio"))


@query(f"SELECT hook_id, scope, array_to_string({q.search_tokens('summary_title')}, ' ') AS tokens FROM hooks WHERE summary_title IS NOT NULL")
def scalar_search_tokens(spark, folder):
    rows = load(spark, folder, "hooks").filter("summary_title is not null")
    return rows.select("hook_id", "scope", F.array_join(tx.search_tokens("summary_title"), " ").alias("tokens"))


_PAIRED_TITLES = "pairs AS (SELECT memory_id, min(summary_title) AS a, max(summary_title) AS b FROM hooks WHERE summary_title IS NOT NULL AND memory_id IS NOT NULL GROUP BY memory_id)"


def _title_pairs(spark, folder):
    rows = load(spark, folder, "hooks").filter("summary_title is not null and memory_id is not null")
    return rows.groupBy("memory_id").agg(F.min("summary_title").alias("a"), F.max("summary_title").alias("b"))


@query(
    f"WITH {_PAIRED_TITLES} SELECT memory_id, round({q.char_similarity('a', 'b')}, 6) AS chars, round({q.word_similarity('a', 'b')}, 6) AS words, "
    f"round({q.fact_similarity('a', 'b')}, 6) AS facts FROM pairs"
)
def scalar_similarities(spark, folder):
    rounded = lambda c, n: F.round(c, 6).alias(n)
    return _title_pairs(spark, folder).select(
        "memory_id", rounded(tx.char_similarity("a", "b"), "chars"), rounded(tx.word_similarity("a", "b"), "words"), rounded(tx.fact_similarity("a", "b"), "facts")
    )


@query(f"SELECT turn_id, received_at, coalesce({q.chitchat('user_message.text', 'llm_message.text')}, false) AS chitchat FROM sidecar_turns")
def filter_chitchat(spark, folder):
    return load(spark, folder, "sidecar_turns").select(
        "turn_id", "received_at", F.coalesce(tx.is_chitchat("user_message.text", "llm_message.text"), F.lit(False)).alias("chitchat")
    )


@query(f"SELECT turn_id, received_at, {q.question('user_message.text')} AS question FROM sidecar_turns WHERE user_message.text IS NOT NULL")
def filter_questions(spark, folder):
    rows = load(spark, folder, "sidecar_turns").filter("user_message.text is not null")
    return rows.select("turn_id", "received_at", tx.is_question("user_message.text").alias("question"))


@query("SELECT hook_id, scope, CASE WHEN length(trim(coalesce(summary_title, ''), ' ')) > 0 THEN substring(summary_title, 1, 80) || '...' ELSE 'memory ' || memory_id END AS title FROM hooks")
def scalar_titles(spark, folder):
    title = tx.title_of("summary_title", F.concat(F.lit("memory "), "memory_id"))
    return load(spark, folder, "hooks").select("hook_id", "scope", title.alias("title"))


@query("SELECT hook_id, scope, CASE WHEN length(summary_title) > 20 THEN substring(summary_title, 1, 20) || '…' ELSE summary_title END AS short FROM hooks")
def scalar_truncate(spark, folder):
    return load(spark, folder, "hooks").select("hook_id", "scope", tx.truncate("summary_title", 20).alias("short"))


@query(f"SELECT hook_id, scope, {q.normalise('summary_title')} AS answer FROM hooks WHERE summary_title IS NOT NULL")
def scalar_normalised(spark, folder):
    rows = load(spark, folder, "hooks").filter("summary_title is not null")
    return rows.select("hook_id", "scope", tx.normalise_answer("summary_title").alias("answer"))


@query("SELECT memory_id, received_at, strftime(archived_at AT TIME ZONE 'UTC', '%G-W%V') AS week, strftime(archived_at AT TIME ZONE 'UTC', '%Y-%m') AS month FROM memories WHERE archived_at IS NOT NULL")
def scalar_periods(spark, folder):
    rows = load(spark, folder, "memories").filter("archived_at is not null")
    return rows.select("memory_id", "received_at", tx.week_key("archived_at").alias("week"), tx.month_key("archived_at").alias("month"))


_NUMBER = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def _number(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {_NUMBER}) THEN CAST({x} AS DOUBLE) END"


def _after(mark: str) -> str:
    return f"CASE WHEN contains(x, '{mark}') THEN {_number(f"trim(list_last(string_split(x, '{mark}')), chr(9) || chr(13) || ' ')")} END"


@query(
    f"WITH d AS (SELECT doc_id, trim(text, chr(9) || chr(10) || chr(13) || ' ') AS t FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - doc_id, 'Score ' || doc_id % 7 || ': ' || doc_id % 150 || chr(10) || 'so 3' FROM documents) WHERE text IS NOT NULL), "
    f"l AS (SELECT doc_id, t, list_filter(list_transform(string_split(t, chr(10)), lambda y: list_transform([trim(y, chr(9) || chr(13) || ' ')], lambda x: coalesce({_after('：')}, {_after(':')}, {_after(' ')}))[1]), lambda v: v IS NOT NULL) AS tails FROM d) "
    f"SELECT doc_id, CASE WHEN s IS NOT NULL THEN least(greatest(s, 0), 100) END AS score FROM (SELECT doc_id, coalesce({_number('t')}, tails[1], {_number("regexp_extract(t, '([-0-9.]+)', 1)")}) AS s FROM l)"
)
def scalar_parsed_scores(spark, folder):
    """Scores of the documents' texts, and of a made reply for each."""
    rows = load(spark, folder, "documents").select("doc_id", "text")
    made = rows.select((-1 - F.col("doc_id")).alias("doc_id"), F.concat(F.lit("Score "), F.col("doc_id") % 7, F.lit(": "), F.col("doc_id") % 150, F.lit("\nso 3")).alias("text"))
    return rows.unionByName(made).filter("text is not null").select("doc_id", tx.parse_score("text").alias("score"))


# Turns


@query(f"{_TURNS} SELECT turn_id, array_to_string(tags, ',') AS tags FROM turns")
def turn_tags(spark, folder):
    return _turns(spark, folder).select("turn_id", F.array_join("tags", ",").alias("tags"))


@query(f"{_TURNS} SELECT turn_id, tokens, greatest({q.message_tokens('user_message', False, 0)} + {q.message_tokens('llm_message', False, 0)}, 1)::BIGINT AS without_names FROM turns")
def turn_token_totals(spark, folder):
    return _turns(spark, folder).select("turn_id", "tokens", turns.estimated_turn_tokens().alias("without_names"))


@query(f"{_TURNS} SELECT turn_id, len(list_filter(tags, lambda x: x IN ({q.strings(turns.HIGH_VALUE_TAGS)}))) > 0 AS high_value FROM turns")
def filter_high_value(spark, folder):
    return _turns(spark, folder).select("turn_id", turns.is_high_value(F.col("tags")).alias("high_value"))


@query(f"{_TURNS} SELECT session_id, sum(tokens)::BIGINT AS tokens, count(*) AS turns FROM turns WHERE list_contains(tags, 'CodeBlock') OR list_contains(tags, 'Url') GROUP BY session_id")
def filter_by_tags(spark, folder):
    rows = _turns(spark, folder).filter(F.arrays_overlap("tags", F.array(F.lit("CodeBlock"), F.lit("Url"))))
    return rows.groupBy("session_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("turns"))


@query(
    f"{_TURNS}, tagged AS (SELECT DISTINCT session_id, unnest(tags) AS tag FROM turns), tags AS (SELECT session_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM tagged GROUP BY session_id), "
    "sums AS (SELECT session_id, sum(tokens)::BIGINT AS total_tokens, count(*) AS turns FROM turns GROUP BY session_id) "
    "SELECT s.session_id, total_tokens, turns, tags FROM sums s JOIN tags g ON s.session_id IS NOT DISTINCT FROM g.session_id"
)
def aggregate_rollup(spark, folder):
    rows = _turns(spark, folder)
    return rows.groupBy("session_id").agg(
        F.sum("tokens").alias("total_tokens"), F.count("*").alias("turns"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))), ",").alias("tags")
    )


_BATCHES = f"""o AS (SELECT session_id, user_message.text AS user_text, llm_message.text AS llm_text, {q.turn_tokens()} AS tokens, row_number() OVER (PARTITION BY session_id ORDER BY created_at, turn_id) AS i FROM t),
f AS (SELECT session_id, i, 0::BIGINT AS batch, tokens, tokens AS total FROM o WHERE i = 1
 UNION ALL SELECT o.session_id, o.i, f.batch + CASE WHEN f.total >= 2000 THEN 1 ELSE 0 END, o.tokens, CASE WHEN f.total >= 2000 THEN 0 ELSE f.total END + o.tokens
 FROM f JOIN o ON o.session_id IS NOT DISTINCT FROM f.session_id AND o.i = f.i + 1)"""


@query(f"WITH RECURSIVE {_LATEST_TURNS}, {_BATCHES} SELECT session_id, batch, sum(tokens)::BIGINT AS batch_tokens, count(*) AS turns, sum(tokens) >= 3000 AS truncated FROM f GROUP BY session_id, batch")
def aggregate_batches(spark, folder):
    return turns.batch_turns(_turns(spark, folder), 2000)


@query(f"{_TURNS} SELECT session_id, sum(tokens)::BIGINT AS tokens, CASE WHEN floor(sum(tokens) * 100.0 / 2000 + 0.5) >= 100 THEN 'archive' WHEN floor(sum(tokens) * 100.0 / 2000 + 0.5) >= 80 THEN 'soon' ELSE 'wait' END AS advice FROM turns GROUP BY session_id")
def scalar_threshold_advice(spark, folder):
    sums = _turns(spark, folder).groupBy("session_id").agg(F.sum("tokens").alias("tokens"))
    return sums.withColumn("advice", storage.threshold_advice(F.col("tokens"), 2000))


@query(f"{_TURNS} SELECT session_id, turn_id, tokens FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, turn_id) AS k FROM turns WHERE tokens > 100) WHERE k <= 10")
def filter_retained(spark, folder):
    return lifecycle.retained(_turns(spark, folder)).select("session_id", "turn_id", "tokens")


# Sequences of messages

_NUMBERED = f"""WITH {_MESSAGES}, n AS (SELECT *, sum(CASE WHEN role = 'assistant' THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY seq, id ROWS UNBOUNDED PRECEDING)::BIGINT AS turn
FROM messages WHERE coalesce(role, '') NOT IN ('system', 'synthetic', 'shell', 'compaction'))"""


@query(
    f"""{_NUMBERED} SELECT session_id, turn, max(CASE WHEN role <> 'assistant' THEN text END) AS user_text, coalesce(string_agg(CASE WHEN role = 'assistant' AND text <> '' THEN text END, chr(10) || chr(10) ORDER BY seq, id), '') AS llm_text,
sum(CASE WHEN role = 'assistant' THEN tokens END)::BIGINT AS tokens, arg_max(finish, (seq, id)) FILTER (role = 'assistant' AND finish IS NOT NULL) AS stop_reason, arg_max(cost, (seq, id)) FILTER (role = 'assistant' AND cost IS NOT NULL) AS cost, count(*) AS messages
FROM n GROUP BY session_id, turn"""
)
def window_pair_turns(spark, folder):
    return turns.pair_turns(_messages(spark, folder))


_NEIGHBOURS = f"WITH {_MESSAGES}, n AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text, lag(role) OVER w AS last_role FROM messages WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY session_id ORDER BY seq, id))"


@query(f"{_NEIGHBOURS} SELECT session_id, seq, text AS user_text, next_text AS llm_text FROM n WHERE role = 'user' AND next_role = 'assistant'")
def window_strict_pairs(spark, folder):
    return turns.strict_pairs(_messages(spark, folder))


@query(
    f"""{_NEIGHBOURS} SELECT * FROM (SELECT session_id, seq, CASE WHEN role = 'user' THEN text ELSE '' END AS user_text, CASE WHEN role = 'assistant' THEN text WHEN next_role = 'assistant' THEN next_text ELSE '' END AS llm_text
FROM n WHERE role = 'user' OR coalesce(last_role, '') <> 'user') WHERE user_text <> '' OR llm_text <> ''"""
)
def window_lenient_pairs(spark, folder):
    return turns.lenient_pairs(_messages(spark, folder))


@query(f"WITH {_MESSAGES}, n AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM messages WINDOW w AS (PARTITION BY session_id ORDER BY seq, id)) SELECT session_id, seq, text AS user_text, CASE WHEN next_role <> 'user' THEN next_text ELSE '' END AS llm_text FROM n WHERE role = 'user'")
def window_speaker_pairs(spark, folder):
    return turns.speaker_pairs(_messages(spark, folder), "user", speaker="role")


@query(f"WITH {_MESSAGES} SELECT id, session_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC, id) AS k FROM messages) WHERE k <= 5")
def window_keep_recent(spark, folder):
    return turns.keep_recent(_messages(spark, folder), 5).select("id", "session_id")


@query(f"WITH {_MESSAGES} SELECT id, session_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq, id) AS k FROM messages) WHERE k <= 3")
def window_first(spark, folder):
    return turns.keep_recent(_messages(spark, folder), 3, oldest=True).select("id", "session_id")


@query(f"WITH {_MESSAGES} SELECT id, used FROM (SELECT *, sum({q.tokens('text')}) OVER (PARTITION BY session_id ORDER BY seq DESC, id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM messages) WHERE used <= 500")
def window_token_budget(spark, folder):
    return turns.within_budget(_messages(spark, folder), 500).select("id", "used")


@query(f"WITH {_MESSAGES} SELECT id, distance, ceil(distance / 1000)::BIGINT AS bucket FROM (SELECT *, sum(length(text)) OVER (PARTITION BY session_id ORDER BY seq, id ROWS UNBOUNDED PRECEDING)::BIGINT AS distance FROM messages)")
def aggregate_distance_buckets(spark, folder):
    rows = _messages(spark, folder).withColumn("length", F.length("text"))
    return metrics.distance_buckets(rows, "session_id", ["seq", "id"], "length").select("id", "distance", "bucket")


@query(
    f"WITH {_MESSAGES}, d AS (SELECT role, text, ceil(sum(length(text)) OVER (PARTITION BY session_id ORDER BY seq, id ROWS UNBOUNDED PRECEDING) / 1000)::BIGINT AS bucket FROM messages) "
    "SELECT role, bucket, count(*) AS asked, round(avg((length(text) > 100)::INTEGER), 6) AS accuracy FROM d GROUP BY role, bucket"
)
def metric_accuracy_by_distance(spark, folder):
    """By role as the category; a text of more than 100 characters stands for a right answer."""
    rows = _messages(spark, folder).withColumn("length", F.length("text"))
    placed = metrics.distance_buckets(rows, "session_id", ["seq", "id"], "length")
    return metrics.accuracy_by_distance(placed.withColumn("correct", F.col("length") > 100), "role", "correct")


@query("SELECT delivery_id, lag(seq) OVER (PARTITION BY session_id ORDER BY seq NULLS FIRST, delivery_id) AS previous FROM compactions")
def window_previous_seq(spark, folder):
    return increments.previous_seq(load(spark, folder, "compactions")).select("delivery_id", "previous")


@query(
    f"""{_TURNS}, n AS (SELECT session_id, turn_id, user_message.text AS user_text, lead(user_message.text) OVER (PARTITION BY session_id ORDER BY turn_id) AS next_user_text FROM turns)
SELECT turn_id, next_user_text FROM n"""
)
def window_rounds(spark, folder):
    rows = _turns(spark, folder).select("session_id", "turn_id", F.col("turn_id").alias("turn"), F.col("user_message.text").alias("user_text"))
    return turns.rounds(rows).select("turn_id", "next_user_text")


@query(
    """WITH d AS (SELECT id, received_at, CASE WHEN json_valid(data) THEN data END AS j, CASE WHEN json_valid(data) AND json_type(data->'$.content') = 'ARRAY' THEN CAST(data->'$.content' AS JSON[]) ELSE [] END AS parts FROM session_messages),
t AS (SELECT *, list_filter(parts, lambda p: p->>'$.type' = 'text' AND p->>'$.text' IS NOT NULL) AS texts, list_filter(parts, lambda p: p->>'$.type' = 'reasoning' AND p->>'$.text' IS NOT NULL) AS thoughts FROM d)
SELECT id, received_at, coalesce(j->>'$.text', array_to_string(list_transform(texts, lambda p: p->>'$.text'), chr(10))) AS text, array_to_string(list_transform(thoughts, lambda p: p->>'$.text'), chr(10) || chr(10)) AS reasoning,
len(list_filter(parts, lambda p: p->>'$.type' = 'tool')) AS tools, NULL::BIGINT AS tokens, j->>'$.finish' AS finish, CAST(j->>'$.cost' AS DOUBLE) AS cost FROM t"""
)
def source_payloads(spark, folder):
    return context.parse_payloads(load(spark, folder, "session_messages"))


@query(
    r"""WITH d AS (SELECT DISTINCT memory_id, content AS t, starts_with(ltrim(content, ' '), '[') AS is_json FROM memories WHERE content IS NOT NULL),
j AS (SELECT memory_id, unnest(CAST(t AS JSON[])) AS e, generate_subscripts(CAST(t AS JSON[]), 1) AS turn FROM d WHERE is_json AND json_valid(t)),
l AS (SELECT memory_id, unnest(string_split(replace(t, chr(13) || chr(10), chr(10)), chr(10))) AS line, unnest(range(len(string_split(replace(t, chr(13) || chr(10), chr(10)), chr(10))))) AS i FROM d WHERE NOT is_json),
m AS (SELECT *, regexp_extract(line, '^\s*(User|Assistant|Human|AI):', 1) AS mark, regexp_replace(line, '^\s*(User|Assistant|Human|AI):\s*', '') AS body FROM l),
n AS (SELECT *, sum(CASE WHEN mark IN ('User', 'Human') THEN 1 ELSE 0 END) OVER w AS turn, last_value(nullif(mark, '') IGNORE NULLS) OVER w AS speaker FROM m WINDOW w AS (PARTITION BY memory_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
g AS (SELECT memory_id, turn, trim(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (speaker IN ('User', 'Human')), ''), ' ') AS user_text, trim(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (speaker IN ('Assistant', 'AI')), ''), ' ') AS llm_text FROM n WHERE speaker IS NOT NULL GROUP BY memory_id, turn),
f AS (SELECT memory_id, turn, e->'$.user_message'->>'$.text' AS user_text, e->'$.llm_message'->>'$.text' AS llm_text FROM j)
SELECT memory_id, turn::BIGINT AS turn, user_text, llm_text FROM g WHERE user_text <> '' OR llm_text <> '' UNION ALL SELECT memory_id, turn::BIGINT, user_text, llm_text FROM f WHERE coalesce(user_text, '') <> '' OR coalesce(llm_text, '') <> ''"""
)
def source_context(spark, folder):
    return context.parse_context(load(spark, folder, "memories").select("memory_id", "content").distinct(), "memory_id", "content")


@query("SELECT DISTINCT memory_id, period, importance, access_count, truncated FROM memories")
def source_documents(spark, folder):
    rows = load(spark, folder, "memories").select("memory_id", "period", "importance", "access_count", "truncated")
    return documents.from_documents(documents.to_documents(rows), rows.schema.simpleString()).distinct()


@query("SELECT DISTINCT memory_id, period, importance, access_count, truncated FROM memories")
def source_packed_documents(spark, folder):
    rows = load(spark, folder, "memories").select("memory_id", "period", "importance", "access_count", "truncated")
    return packed.from_packed(packed.to_packed(rows, "memory_id"), "memory_id", rows.schema.simpleString()).drop("memory_id_of").distinct()


@query(f"WITH {_MESSAGES}, p AS (SELECT id, CASE WHEN json_type(j->'$.content') = 'ARRAY' THEN CAST(j->'$.content' AS JSON[]) END AS parts FROM parsed) SELECT id, array_to_string(list_transform(list_filter(parts, lambda x: x->>'$.text' IS NOT NULL), lambda x: x->>'$.text'), chr(10)) AS text FROM p WHERE parts IS NOT NULL AND len(parts) > 0")
def join_messages_parts(spark, folder):
    """Content parts as rows of their own, as the older layout has them, joined to their messages again."""
    rows = storage.latest(load(spark, folder, "session_messages").filter("session_id is not null and seq is not null").select("id", "data", "received_at"), ["id"], ["received_at"])
    lists = rows.select("id", F.posexplode(F.expr("try_variant_get(try_parse_json(data), '$.content', 'array<variant>')")).alias("at", "part"))
    parts = lists.select(F.col("id").alias("message_id"), F.format_string("%s-%06d", "id", "at").alias("id"), F.to_json("part").alias("data"))
    return documents.with_parts(rows.select("id"), parts).filter("text is not null").select("id", "text")


@query("SELECT doc_id, md5(text || chr(10) || '<!-- notes -->' || chr(10) || 'two' || chr(10) || 'three' || chr(10) || '<!-- /notes -->' || chr(10)) AS digest FROM documents WHERE text IS NOT NULL")
def scalar_edit_section(spark, folder):
    """A section is added to each text, replaced, and appended to."""
    text = tx.edit_section("text", "notes", "one")
    text = tx.edit_section(tx.edit_section(text, "notes", "two"), "notes", "three", "append")
    return load(spark, folder, "documents").filter("text is not null").select("doc_id", F.md5(text).alias("digest"))


@query("SELECT event_id, date_trunc('minute', ts) AS first, date_trunc('minute', ts) AS second, props AS inner_json FROM events")
def scalar_dialogue_times(spark, folder):
    """Times written in the two ways of dialogues and read again, and JSON out of a fence."""
    ts = F.col("ts").cast("timestamp")
    rows = load(spark, folder, "events").select("event_id", F.date_format(ts, "yyyy/MM/dd (EEE) HH:mm").alias("a"), F.concat(F.lower(F.date_format(ts, "h:mm a")), F.date_format(ts, "' on 'd MMMM, yyyy")).alias("b"), F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone.")).alias("c"))
    return rows.select("event_id", tx.dialogue_time("a").cast("timestamp_ntz").alias("first"), tx.dialogue_time("b").cast("timestamp_ntz").alias("second"), tx.fenced_json("c").alias("inner_json"))


# Storage


@query("SELECT DISTINCT session_id FROM memories WHERE session_id IS NOT NULL")
def storage_sessions(spark, folder):
    return load(spark, folder, "memories").select("session_id").filter("session_id is not null").distinct()


@query("SELECT DISTINCT project_id, memory_id FROM memories WHERE project_id IS NOT NULL")
def storage_project_memories(spark, folder):
    return load(spark, folder, "memories").select("project_id", "memory_id").filter("project_id is not null").distinct()


@query("WITH m AS (SELECT session_id, period, memory_id, min(archived_at) AS archived_at FROM memories GROUP BY session_id, period, memory_id) SELECT session_id, period, row_number() OVER (PARTITION BY session_id, period ORDER BY archived_at NULLS FIRST, memory_id) AS n, memory_id FROM m")
def storage_list_memories(spark, folder):
    return storage.list_memories(load(spark, folder, "memories"))


@query("SELECT session_id, max(saved_at) AS saved_at, max_by(last_seq, saved_at) AS last_seq FROM (SELECT saved_at, unnest(map_entries(last_archived_seq)).key AS session_id, unnest(map_entries(last_archived_seq)).value AS last_seq FROM sidecar_state) GROUP BY session_id")
def storage_latest_state(spark, folder):
    rows = load(spark, folder, "sidecar_state").select("saved_at", F.explode("last_archived_seq").alias("session_id", "last_seq"))
    return storage.latest(rows.select("session_id", "saved_at", "last_seq"), ["session_id"], ["saved_at"])


@query("SELECT hook_id, scope, CASE WHEN memory_id IN (SELECT memory_id FROM memories WHERE truncated) THEN 'deleted' ELSE file_status END AS file_status FROM hooks")
def storage_soft_delete(spark, folder):
    gone = load(spark, folder, "memories").filter("truncated")
    return storage.mark_deleted(load(spark, folder, "hooks"), gone).select("hook_id", "scope", "file_status")


@query("SELECT memory_id, received_at FROM memories WHERE memory_id NOT IN (SELECT memory_id FROM hooks WHERE file_status = 'corrupted' AND memory_id IS NOT NULL)")
def storage_hard_delete(spark, folder):
    keys = load(spark, folder, "hooks").filter("file_status = 'corrupted'")
    return storage.without(load(spark, folder, "memories"), keys, "memory_id").select("memory_id", "received_at")


@query("SELECT memory_id, count(*) AS rows FROM (SELECT memory_id FROM memories WHERE period <> 'daily' AND memory_id NOT IN (SELECT memory_id FROM memories WHERE period = 'daily') UNION ALL SELECT memory_id FROM memories WHERE period = 'daily') GROUP BY memory_id")
def storage_upsert(spark, folder):
    rows = load(spark, folder, "memories").select("memory_id", "period", "received_at")
    return storage.upsert(rows.filter("period <> 'daily'"), rows.filter("period = 'daily'"), ["memory_id"]).groupBy("memory_id").agg(F.count("*").alias("rows"))


@query("WITH r AS (SELECT DISTINCT memory_id FROM hooks WHERE memory_id IS NOT NULL), m AS (SELECT DISTINCT memory_id FROM memories) SELECT count(*) AS total, count(m.memory_id) AS success_count FROM r LEFT JOIN m USING (memory_id)")
def storage_batch_read(spark, folder):
    requested = load(spark, folder, "hooks").select("memory_id").filter("memory_id is not null").distinct()
    return storage.batch_summary(storage.batch_lookup(requested, load(spark, folder, "memories"), "memory_id", ["period"]))


_PREFIX = "(SELECT substring(min(hook_id), 1, 4) FROM hooks WHERE hook_id IS NOT NULL)"


def _prefix(spark, folder) -> str:
    """The first four characters of the least hook id."""
    return load(spark, folder, "hooks").agg(F.substring(F.min("hook_id"), 1, 4)).first()[0]


@query(
    f"WITH r AS (SELECT *, CASE scope WHEN 'session' THEN 1 WHEN 'project' THEN 2 END AS rank FROM hooks WHERE (file_status IS NULL OR file_status <> 'deleted') AND starts_with(hook_id, {_PREFIX})) "
    "SELECT hook_id, archived_at, memory_id, scope FROM (SELECT *, row_number() OVER (PARTITION BY hook_id ORDER BY rank, archived_at, memory_id) AS k FROM r WHERE rank IS NOT NULL) WHERE k = 1"
)
def filter_prefix(spark, folder):
    return storage.find_by_prefix(load(spark, folder, "hooks"), _prefix(spark, folder))


@query(
    f"WITH a AS (SELECT DISTINCT hook_id FROM hooks WHERE (file_status IS NULL OR file_status <> 'deleted') AND scope IN ('session', 'project') AND starts_with(hook_id, {_PREFIX})) "
    "SELECT CASE WHEN count(*) = 1 THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN count(*) = 1 THEN min(hook_id) END AS hook_id, CASE WHEN count(*) > 1 THEN (SELECT string_agg(hook_id, ',' ORDER BY hook_id) FROM (SELECT h.hook_id FROM hooks h JOIN a USING (hook_id) GROUP BY h.hook_id ORDER BY min(h.archived_at), h.hook_id LIMIT 5)) END AS candidates FROM a"
)
def filter_resolve_prefix(spark, folder):
    return storage.resolve_prefix(load(spark, folder, "hooks"), _prefix(spark, folder)).withColumn("candidates", F.array_join("candidates", ","))


@query("SELECT memory_id, session_id, received_at, md5(content) AS digest FROM memories WHERE memory_id = (SELECT min(memory_id) FROM memories)")
def storage_read_memory(spark, folder):
    memories = load(spark, folder, "memories")
    first = memories.agg(F.min("memory_id")).first()[0]
    return storage.by_id(memories, "memory_id", first).select("memory_id", "session_id", "received_at", F.md5("content").alias("digest"))


_HOOK_COLUMNS = ["hook_id", "memory_id", "session_id", "scope", "period", "summary_title", "archived_at"]


def _hooks(spark, folder) -> DataFrame:
    return load(spark, folder, "hooks").filter("hook_id is not null and scope is not null and period is not null").select(*_HOOK_COLUMNS).distinct()


_HOOKS = f"h AS (SELECT DISTINCT {', '.join(_HOOK_COLUMNS)} FROM hooks WHERE hook_id IS NOT NULL AND scope IS NOT NULL AND period IS NOT NULL)"


@query(
    f"""WITH {_HOOKS}, late AS (SELECT *, summary_title || ' again' AS t FROM h WHERE archived_at >= TIMESTAMPTZ '2025-08-01 00:00:00+00'), gone AS (SELECT DISTINCT scope, session_id, period FROM h WHERE period = 'monthly' AND scope = 'project')
SELECT hook_id, memory_id, session_id, scope, period, summary_title, archived_at FROM (
  SELECT * FROM h WHERE NOT EXISTS (FROM late l WHERE l.scope = h.scope AND l.period = h.period AND l.session_id IS NOT DISTINCT FROM h.session_id)
  UNION ALL SELECT hook_id, memory_id, session_id, scope, period, t, archived_at FROM late)
WHERE NOT (period = 'monthly' AND scope = 'project')"""
)
def storage_index_documents(spark, folder):
    """All documents are written; those with late hooks are replaced by these alone; the monthly ones of projects are deleted."""
    hooks = _hooks(spark, folder)
    store = storage.HookStore(spark, new_folder(spark, "hooks"), hooks.schema).write(hooks)
    store.write(hooks.filter("archived_at >= timestamp '2025-08-01 00:00:00'").withColumn("summary_title", F.concat("summary_title", F.lit(" again"))))
    return store.delete(hooks.filter("period = 'monthly' and scope = 'project'")).read()


@query(
    f"""WITH {_HOOKS}, one AS (SELECT hook_id, scope, arg_max((memory_id, session_id, period, summary_title, archived_at), archived_at) AS r FROM h GROUP BY hook_id, scope)
SELECT scope, period, count(*) AS hooks, count(*) FILTER (summary_title LIKE '% again') AS again FROM (
  SELECT scope, period, summary_title FROM h WHERE scope = 'session' AND period <> 'daily' UNION ALL SELECT scope, period, summary_title || ' again' FROM h WHERE scope = 'session' AND period = 'daily' UNION ALL SELECT 'project', period, summary_title FROM h WHERE scope = 'session') GROUP BY scope, period"""
)
def storage_append_hooks(spark, folder):
    """Hooks of sessions, written, then appended to the projects' scope as well, and the daily ones once more with another title."""
    hooks = _hooks(spark, folder).filter("scope = 'session'")
    store = storage.HookStore(spark, new_folder(spark, "hooks"), hooks.schema).write(hooks)
    store.append(hooks.withColumn("scope", F.lit("project")))
    store.append(hooks.filter("period = 'daily'").withColumn("summary_title", F.concat("summary_title", F.lit(" again"))))
    rows = store.read()
    return rows.groupBy("scope", "period").agg(F.count("*").alias("hooks"), F.count_if(F.col("summary_title").endswith(" again")).alias("again"))


@query("WITH d AS (SELECT DISTINCT session_id, memory_id, archived_at FROM memories WHERE period = 'daily' AND session_id IS NOT NULL) SELECT session_id, memory_id, row_number() OVER (PARTITION BY session_id ORDER BY archived_at, memory_id) AS n FROM d")
def storage_standalone_memories(spark, folder):
    rows = load(spark, folder, "memories").withColumn("link", F.when(F.col("period") == "daily", "standalone").otherwise("linked"))
    return storage.linked_memories(rows, "standalone", "session_id")


@query("WITH d AS (SELECT DISTINCT project_id, memory_id, archived_at FROM memories WHERE period <> 'daily' AND project_id IS NOT NULL) SELECT project_id, memory_id, row_number() OVER (PARTITION BY project_id ORDER BY archived_at, memory_id) AS n FROM d")
def storage_linked_memories(spark, folder):
    rows = load(spark, folder, "memories").withColumn("link", F.when(F.col("period") == "daily", "standalone").otherwise("linked"))
    return storage.linked_memories(rows, "linked", "project_id")


@query(
    "WITH c AS (SELECT session_id, message_id AS hook_id, CASE WHEN reason = 'manual' THEN NULL ELSE summary END AS text, received_at AS put, delivery_id FROM compactions WHERE session_id IS NOT NULL AND message_id IS NOT NULL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY session_id, hook_id ORDER BY put DESC) AS k, count(*) OVER (PARTITION BY session_id, hook_id, put) AS ties FROM c) SELECT session_id, hook_id, md5(text) AS digest FROM r WHERE k = 1 AND ties = 1 AND text IS NOT NULL"
)
def storage_raw_contexts(spark, folder):
    """Compaction summaries as raw contexts, early ones stored first, the rest as changes; manual ones delete. Keys with ties in time are left out."""
    rows = load(spark, folder, "compactions").filter("session_id is not null and message_id is not null")
    rows = rows.select("session_id", F.col("message_id").alias("hook_id"), F.when(F.coalesce("reason", F.lit("")) != "manual", F.col("summary")).alias("text"), F.col("received_at").alias("at"))
    early = F.col("at") < F.lit("2025-06-01").cast("timestamp")
    kept = storage.put_contexts(rows.filter(early), rows.filter(~early))
    ties = rows.groupBy("session_id", "hook_id", "at").agg(F.count("*").alias("n")).filter("n > 1")
    return kept.join(ties, ["session_id", "hook_id", "at"], "left_anti").select("session_id", "hook_id", F.md5("text").alias("digest"))


@query("SELECT user_id::VARCHAR AS memory_id, count(*) AS accesses FROM events WHERE event_type = 'view' GROUP BY user_id")
def storage_access_counts(spark, folder):
    log = load(spark, folder, "events").filter("event_type = 'view'").select(F.col("user_id").cast("string").alias("memory_id"))
    return storage.access_counts(log)


@query(
    "WITH r AS (SELECT DISTINCT memory_id FROM hooks WHERE file_status = 'deleted' OR period = 'monthly'), m AS (SELECT DISTINCT memory_id FROM memories) "
    "SELECT 'rest' AS kind, memory_id FROM m WHERE memory_id NOT IN (SELECT memory_id FROM r WHERE memory_id IS NOT NULL) UNION ALL SELECT CASE WHEN m.memory_id IS NOT NULL THEN 'deleted' ELSE 'failed' END, r.memory_id FROM r LEFT JOIN m USING (memory_id)"
)
def storage_batch_delete(spark, folder):
    requested = load(spark, folder, "hooks").filter("file_status = 'deleted' or period = 'monthly'").select("memory_id")
    rest, results = storage.batch_delete(requested, load(spark, folder, "memories"), "memory_id")
    return rest.select(F.lit("rest").alias("kind"), "memory_id").distinct().unionByName(results.select(F.when(F.col("success"), "deleted").otherwise("failed").alias("kind"), "memory_id"))


@query("WITH c AS (SELECT memory_id, CASE WHEN max(token_count) IS NOT NULL THEN least(greatest(max(token_count - 500), 0), 100) END AS importance FROM hooks GROUP BY memory_id) SELECT m.memory_id, m.received_at, coalesce(c.importance, m.importance)::INTEGER AS importance FROM memories m LEFT JOIN c USING (memory_id)")
def storage_batch_update(spark, folder):
    changes = load(spark, folder, "hooks").select("memory_id", (F.col("token_count") - 500).cast("int").alias("importance"))
    table, _ = storage.batch_update(changes, load(spark, folder, "memories"), "memory_id")
    return table.select("memory_id", "received_at", F.col("importance").cast("int").alias("importance"))


@query(
    """WITH h AS (SELECT DISTINCT hook_id, session_id, period, archived_at, summary_title, tags, token_count, CASE WHEN archive_reason = 'manual' THEN [summary_title, archive_reason] END AS facts, CASE WHEN token_count > 1000 THEN 'long ' || period END AS abstract FROM hooks WHERE scope = 'session' AND summary_title IS NOT NULL AND (file_status IS NULL OR file_status <> 'deleted')),
e AS (SELECT *, CASE period WHEN 'daily' THEN len(list_intersect(coalesce(tags, []), ['ToolCall', 'Thinking', 'AgentTool', 'CodeBlock', 'FileAttachment', 'Image', 'Video'])) > 0 AND len(facts) > 0 WHEN 'weekly' THEN len(facts) > 0 OR abstract IS NOT NULL ELSE period = 'monthly' END AS more FROM h),
l AS (SELECT *, '- **' || summary_title || '**' || CASE WHEN len(tags) > 0 AND array_to_string(tags, ', ') <> '' THEN ' [' || array_to_string(tags, ', ') || ']' ELSE '' END || ' (' || coalesce(token_count, 0) || ' tokens)' || chr(10) || '  - id: `' || hook_id || '`'
  || CASE WHEN more AND abstract IS NOT NULL THEN chr(10) || '  - abstract: ' || abstract ELSE '' END || CASE WHEN more AND len(facts) > 0 THEN chr(10) || '  - facts:' || chr(10) || array_to_string(list_transform(facts, lambda x: '    - ' || x), chr(10)) ELSE '' END AS line FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, period ORDER BY archived_at DESC NULLS LAST, hook_id DESC, line DESC) AS k FROM l)
SELECT session_id, period, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY rank DESC, archived_at, hook_id, line)) AS digest FROM (SELECT *, """
    + q.relevance("retry index 消息").replace("coalesce(summary_title, '')", "summary_title")
    + """ AS rank FROM r WHERE k <= 15) GROUP BY session_id, period"""
)
def aggregate_ranked_prompts(spark, folder):
    """The hooks of a session by relevance, each as far as its period has it told."""
    rows = load(spark, folder, "hooks").filter("scope = 'session' and summary_title is not null").select("hook_id", "session_id", "period", "archived_at", "summary_title", "tags", "token_count", "archive_reason", "file_status").distinct()
    told = rows.withColumns(
        {
            "key_facts": F.when(F.col("archive_reason") == "manual", F.array("summary_title", "archive_reason")), "key_entities": F.lit(None).cast("array<string>"),
            "abstract": F.when(F.col("token_count") > 1000, F.concat(F.lit("long "), "period")),
        }
    )
    ranked = tx.relevance("retry index 消息", F.col("summary_title"), F.col("tags"))
    return storage.prompt_lines(storage.prompt_entry(told), ranked).select("session_id", "period", "lines", F.md5("prompt").alias("digest"))


@query(
    f"""WITH h AS (SELECT DISTINCT session_id, period, archived_at, hook_id, summary_title FROM hooks WHERE session_id IS NOT NULL AND (file_status IS NULL OR file_status <> 'deleted')), l AS (SELECT *, '- ' || coalesce(summary_title, '?') || ' [' || hook_id || ']' AS line FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, period ORDER BY archived_at DESC NULLS LAST, hook_id DESC, line DESC) AS k FROM l), p AS (SELECT session_id, period, string_agg(line, chr(10) ORDER BY archived_at, hook_id, line) AS prompt FROM r WHERE k <= 15 GROUP BY session_id, period),
s AS (SELECT session_id, arg_max((reason, recent), (received_at, delivery_id)) AS v FROM (SELECT *, count(*) OVER (PARTITION BY session_id, received_at) AS ties FROM compactions WHERE session_id IS NOT NULL) WHERE ties = 1 GROUP BY session_id)
SELECT session_id, period, md5(prompt || CASE WHEN s.session_id IS NOT NULL THEN chr(10) || 'current task: ' || coalesce(v[1], '?') || coalesce(chr(10) || 'next step: ' || v[2], '') ELSE '' END) AS digest FROM p LEFT JOIN s USING (session_id)"""
)
def storage_prompt_with_snapshot(spark, folder):
    """Prompts with the session's last compaction as what it was doing; compactions with ties in time are left out."""
    events = load(spark, folder, "compactions").filter("session_id is not null")
    ties = events.groupBy("session_id", "received_at").agg(F.count("*").alias("n")).filter("n > 1")
    snapshots = events.join(ties, ["session_id", "received_at"], "left_anti").select("session_id", F.col("received_at").alias("at"), F.col("reason").alias("task"), F.col("recent").alias("next_step"))
    return storage.with_snapshot(aggregate_prompts(spark, folder).filter("session_id is not null"), snapshots).select("session_id", "period", F.md5("prompt").alias("digest"))


@query("SELECT DISTINCT hook_id, memory_id, period, scope, summary_title, coalesce(array_to_string(tags, ', '), '') AS tag_names, strftime(archived_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS archived, token_count FROM hooks WHERE file_status IS NULL OR file_status <> 'deleted'")
def storage_summary_view(spark, folder):
    return storage.summary_view(load(spark, folder, "hooks")).distinct()


@query("WITH m AS (SELECT memory_id, max(content) AS content FROM memories GROUP BY memory_id) SELECT DISTINCT hook_id, scope, md5(concat_ws(' | ', CASE WHEN trim(summary_title, ' ') <> '' THEN summary_title END, CASE WHEN trim(array_to_string(tags, ' '), ' ') <> '' THEN array_to_string(tags, ' ') END, CASE WHEN trim(content, ' ') <> '' THEN content END)) AS digest FROM hooks LEFT JOIN m USING (memory_id)")
def join_index_text(spark, folder):
    rows = storage.index_text(storage.with_memory_text(load(spark, folder, "hooks"), load(spark, folder, "memories")))
    return rows.select("hook_id", "scope", F.md5("index_text").alias("digest")).distinct()


@query("""WITH h AS (SELECT DISTINCT session_id, period, archived_at, hook_id, summary_title, '- ' || coalesce(summary_title, '?') || ' [' || hook_id || ']' AS line FROM hooks WHERE file_status IS NULL OR file_status <> 'deleted'),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, period ORDER BY archived_at DESC NULLS LAST, hook_id DESC, line DESC) AS k FROM h)
SELECT session_id, period, count(*) AS lines, string_agg(line, chr(10) ORDER BY archived_at, hook_id, line) AS prompt FROM r WHERE k <= 15 GROUP BY session_id, period""")
def aggregate_prompts(spark, folder):
    rows = load(spark, folder, "hooks").select("session_id", "period", "archived_at", "hook_id", "summary_title", "file_status")
    return storage.prompt_lines(storage.not_deleted(rows).drop("file_status").distinct().withColumn("file_status", F.lit(None).cast("string")))


@query("SELECT DISTINCT hook_id, archived_at FROM (SELECT hook_id, archived_at, row_number() OVER (PARTITION BY session_id ORDER BY archived_at DESC, hook_id DESC) AS k FROM (SELECT DISTINCT hook_id, session_id, archived_at FROM hooks)) WHERE k <= 3")
def window_recent_hooks(spark, folder):
    rows = load(spark, folder, "hooks").select("hook_id", "session_id", "archived_at").distinct()
    return storage.recent_hooks(rows, 3, "session_id").select("hook_id", "archived_at").distinct()


@query("SELECT h.hook_id, m.period, count(*) AS n FROM (SELECT DISTINCT hook_id, memory_id FROM hooks) h JOIN (SELECT DISTINCT memory_id, period FROM memories) m USING (memory_id) GROUP BY h.hook_id, m.period")
def join_hooks_memories(spark, folder):
    hooks, memories = load(spark, folder, "hooks"), load(spark, folder, "memories")
    rows = hooks.select("hook_id", "memory_id").distinct().join(memories.select("memory_id", "period").distinct(), "memory_id")
    return rows.groupBy("hook_id", "period").agg(F.count("*").alias("n"))


@query(
    f"""WITH RECURSIVE {_LATEST_TURNS}, {_BATCHES}, said AS (SELECT session_id, i, 1 AS side, user_text AS x FROM o UNION ALL SELECT session_id, i, 2, llm_text FROM o)
SELECT f.session_id, f.batch, md5(string_agg(x, ' ' ORDER BY f.i, side)) AS digest FROM f JOIN said s ON f.session_id IS NOT DISTINCT FROM s.session_id AND f.i = s.i WHERE trim(x, ' ') <> '' GROUP BY f.session_id, f.batch"""
)
def aggregate_turns_text(spark, folder):
    """What is said in each batch of turns."""
    rows = _turns(spark, folder)
    batched = rows.join(turns.number_batches(rows, 2000).select("turn_id", "batch"), "turn_id")
    return turns.turns_text(batched, ["session_id", "batch"], ["created_at", "turn_id"]).select("session_id", "batch", F.md5("text").alias("digest"))


@query("SELECT doc_id, CASE k WHEN 'claude_approx' THEN floor(n * 1.2::DOUBLE + 0.5) WHEN 'deepseek_approx' THEN floor(n * 0.95::DOUBLE + 0.5) ELSE n END::BIGINT AS tokens, k AS tokenizer FROM (SELECT doc_id, " + q.char_tokens("text") + " AS n, unnest(['o200k_base', 'cl100k_base', 'claude_approx', 'deepseek_approx']) AS k FROM documents)")
def scalar_scaled_tokens(spark, folder):
    counts = load(spark, folder, "documents").select("doc_id", tx.char_tokens("text").alias("n"))
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("tokenizer"), tx.scaled_tokens(F.col("n"), k).alias("tokens")) for k in TOKENIZER_FACTORS)))
    return counts.select("doc_id", kinds.alias("k")).select("doc_id", "k.*")


@query("SELECT delivery_id, concat_ws(' ', nullif(reason, ''), nullif(summary, ''), nullif(recent, '')) AS query FROM compactions")
def scalar_search_query(spark, folder):
    return load(spark, folder, "compactions").select("delivery_id", tx.search_query(F.col("reason"), F.col("summary"), F.col("recent")).alias("query"))


_TOKENS = "array_to_string(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}\\p{{M}}]+|[^\\p{{Z}}\\p{{C}}\\s]'), ' ')"


@query(f"SELECT turn_id, received_at, contains(' ' || {_TOKENS.format('llm_message.text')} || ' ', ' the hidden ') OR contains(' ' || {_TOKENS.format('llm_message.text')} || ' ', ' archive . ') AS found FROM sidecar_turns WHERE llm_message.text IS NOT NULL")
def metric_has_answer(spark, folder):
    rows = load(spark, folder, "sidecar_turns").filter("llm_message.text is not null")
    return rows.select("turn_id", "received_at", tx.has_answer("llm_message.text", F.array(F.lit("The hidden"), F.lit(None), F.lit("archive."))).alias("found"))


@query(
    f"WITH c AS (SELECT user_id AS id, 'event ' || event_id AS item, ts AS t FROM events WHERE event_type = 'view'), e AS (SELECT user_id AS id, trim(x) AS expansion, ts AS t FROM (SELECT user_id, ts, unnest(string_split(event_type || '; ' || event_id, ';')) AS x FROM events WHERE value > 400)) "
    "SELECT 'merge' AS how, c.id AS session_id, CASE WHEN e.id IS NULL THEN item ELSE expansion || ' ' || item END AS item, c.t AS \"at\" FROM c LEFT JOIN e USING (id) UNION ALL SELECT 'replace', c.id, coalesce(expansion, item), c.t FROM c LEFT JOIN e USING (id) "
    "UNION ALL SELECT 'separate', id, item, t FROM c UNION ALL SELECT 'separate', id, expansion, t FROM e"
)
def join_expansions(spark, folder):
    events = load(spark, folder, "events").withColumn("session_id", F.col("user_id"))
    corpus = events.filter("event_type = 'view'").select("session_id", F.concat(F.lit("event "), "event_id").alias("item"), F.col("ts").alias("at"))
    told = search.split_expansions(events.filter("value > 400").select("session_id", F.concat_ws("; ", "event_type", "event_id").alias("expansion"), F.col("ts").alias("at")))
    parts = [search.expand_corpus(corpus, told, how).select(F.lit(how).alias("how"), "session_id", "item", "at") for how in ("separate", "merge", "replace")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Search


def _index(spark: SparkSession, folder: str, table: str, id_col: str, text_col: str, by: dict[str, str] | None = None) -> keyword.KeywordIndex:
    """The keyword index of a table, made by the session's first query that needs it and read by the later ones."""
    path = f"{folder}/{table}.parquet"
    state = hashlib.md5(f"{path} {version(spark, path)} {by}".encode()).hexdigest()
    rows = load(spark, folder, table).select(id_col, text_col, *(by or {}))
    index = keyword.KeywordIndex(spark, f"{shared_folder(spark)}/mnemospark/{spark.sparkContext.applicationId}-index/{table}-{state}", dict(rows.dtypes)[id_col], by)
    if not exists(spark, f"{index.folder}/totals"):
        index.index(rows.filter(" and ".join(f"{c} is not null" for c in by)).distinct() if by else rows, id_col, text_col)
    return index


@query(q.bm25("documents", "doc_id", "text", SEARCHED_TERMS) + " SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY score DESC, doc_id LIMIT 20")
def search_bm25(spark, folder):
    best = search.top(search.bm25(_index(spark, folder, "documents", "doc_id", "text"), SEARCHED), 20, "id")
    return best.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(q.bm25("(SELECT * FROM documents WHERE coalesce(doc_kind, '') <> 'review')", "doc_id", "text", {"retry": 1, "index": 1}) + " SELECT doc_id, round(score, 6) AS score FROM scored")
def search_index_maintenance(spark, folder):
    """Older documents first, under texts that the later increment replaces; then all, by source; reviews are removed; the rest is compacted."""
    docs = load(spark, folder, "documents")
    index = keyword.KeywordIndex(spark, new_folder(spark, "index"), dict(docs.dtypes)["doc_id"])
    index.index(docs.filter("created_at < timestamp '2025-06-01'").withColumn("text", F.concat(F.lit("retry index retry "), "text")), "doc_id", "text")
    index.index(docs, "doc_id", "text")
    index.unindex(docs.filter("doc_kind = 'review'").select(F.col("doc_id").alias("id")))
    return index.compact().search("retry index").select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("SELECT vec_id, round(score, 6) AS score FROM (" + q.cosine("embeddings", "vec_id", "embedding", [(i % 7 - 3) / 3 for i in range(64)]) + ") WHERE score > 0 ORDER BY score DESC, vec_id LIMIT 20")
def search_cosine(spark, folder):
    scores = search.vector_scores(load(spark, folder, "embeddings"), "vec_id", "embedding", [(i % 7 - 3) / 3 for i in range(64)])
    return search.top(scores, 20, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT vec_id, round(score, 6) AS score FROM (" + q.cosine("embeddings", "vec_id", "embedding", [(i % 5 - 2) / 2 for i in range(64)], False) + ") WHERE score > 0 ORDER BY score DESC, vec_id LIMIT 20")
def search_inner_product(spark, folder):
    scores = search.vector_scores(load(spark, folder, "embeddings"), "vec_id", "embedding", [(i % 5 - 2) / 2 for i in range(64)], False)
    return search.top(scores, 20, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


_FUSED = (
    q.bm25("documents", "doc_id", "text", SEARCHED_TERMS)
    + ", k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored), v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM ("
    + q.cosine("embeddings", "vec_id", "embedding", [(i % 7 - 3) / 3 for i in range(64)])
    + ") WHERE score > 0), u AS (SELECT * FROM k WHERE r <= 20 UNION ALL SELECT * FROM v WHERE r <= 20)"
)


@query(_FUSED + " SELECT doc_id, round(sum(1.0 / (60 + r)), 6) AS score, 'hybrid' AS source FROM u GROUP BY doc_id ORDER BY sum(1.0 / (60 + r)) DESC, doc_id LIMIT 20")
def search_hybrid(spark, folder):
    found = search.bm25(_index(spark, folder, "documents", "doc_id", "text"), SEARCHED).withColumnRenamed("id", "doc_id")
    vectors = search.vector_scores(load(spark, folder, "embeddings"), "vec_id", "embedding", [(i % 7 - 3) / 3 for i in range(64)])
    fused = search.hybrid(found, vectors.withColumnRenamed("vec_id", "doc_id"), "doc_id", 20)
    return fused.select("doc_id", F.round("score", 6).alias("score"), "source")


@query(q.bm25("documents", "doc_id", "text", {"qqqq": 1}) + ", v AS (" + q.cosine("embeddings", "vec_id", "embedding", [(i % 7 - 3) / 3 for i in range(64)]) + ") SELECT vec_id AS doc_id, round(score, 6) AS score, 'semantic' AS source FROM v WHERE score > 0 AND (SELECT count(*) FROM scored) = 0 ORDER BY v.score DESC, vec_id LIMIT 20")
def search_hybrid_degraded(spark, folder):
    found = search.bm25(_index(spark, folder, "documents", "doc_id", "text"), "qqqq").withColumnRenamed("id", "doc_id")
    vectors = search.vector_scores(load(spark, folder, "embeddings"), "vec_id", "embedding", [(i % 7 - 3) / 3 for i in range(64)])
    fused = search.hybrid(found, vectors.withColumnRenamed("vec_id", "doc_id"), "doc_id", 20)
    return fused.select("doc_id", F.round("score", 6).alias("score"), "source")


@query(
    q.bm25("(SELECT DISTINCT memory_id, project_id, content FROM memories WHERE project_id IS NOT NULL)", "memory_id", "content", SEARCHED_TERMS, by="project_id")
    + ", r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, memory_id) AS k FROM scored) SELECT memory_id, project_id, round(score, 6) AS score FROM r WHERE k <= 3 ORDER BY score DESC, project_id, memory_id LIMIT 10"
)
def search_projects(spark, folder):
    index = _index(spark, folder, "memories", "memory_id", "content", {"project_id": "string"})
    best = search.search_projects(index, SEARCHED, 3, 10)
    return best.select(F.col("id").alias("memory_id"), "project_id", F.round("score", 6).alias("score"))


@query(
    """WITH w AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS w FROM documents), d AS (SELECT doc_id, len(w) AS dl, w FROM w),
s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM d), f AS (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(w)) AS term FROM w) GROUP BY term),
i AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM f CROSS JOIN s), m AS (SELECT avg(idf) AS mean FROM i),
t AS (SELECT unnest(['retry', 'window', 'the']) AS term), k AS (SELECT t.term, CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END AS idf FROM t JOIN i USING (term) CROSS JOIN m),
p AS (SELECT doc_id, dl, k.idf, len(list_filter(w, lambda x: x = k.term)) AS tf FROM d CROSS JOIN k)
SELECT doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM p CROSS JOIN s GROUP BY doc_id ORDER BY sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) DESC, doc_id LIMIT 20"""
)
def search_whitespace_bm25(spark, folder):
    best = search.top(search.okapi(load(spark, folder, "documents"), "doc_id", "text", "retry window the"), 20, "doc_id")
    return best.select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT term, count(*) AS documents, sum(tf)::BIGINT AS occurrences FROM (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({q.search_tokens('text')}) AS term FROM documents WHERE text IS NOT NULL) GROUP BY term, doc_id) GROUP BY term")
def aggregate_term_statistics(spark, folder):
    return _index(spark, folder, "documents", "doc_id", "text").terms()


@query(f"WITH h AS (SELECT DISTINCT hook_id, scope, {q.relevance('retry index 消息')} AS relevance FROM hooks) SELECT * FROM h WHERE relevance > 0")
def search_relevance(spark, folder):
    return search.relevant_hooks(load(spark, folder, "hooks"), "retry index 消息").select("hook_id", "scope", "relevance").distinct()


@query(
    q.bm25("(SELECT DISTINCT memory_id, session_id, content FROM memories WHERE session_id IS NOT NULL)", "memory_id", "content", SEARCHED_TERMS, by="session_id")
    + " SELECT memory_id, session_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, memory_id) AS k FROM scored) WHERE k <= 2"
)
def search_sessions(spark, folder):
    """The two best memories within each session, which sees no other's texts nor their statistics."""
    index = _index(spark, folder, "memories", "memory_id", "content", {"session_id": "string"})
    best = search.top(index.search(SEARCHED), 2, "id", by=["session_id"])
    return best.select(F.col("id").alias("memory_id"), "session_id", F.round("score", 6).alias("score"))


@query("WITH v AS (SELECT vec_id, CASE WHEN label = 1 THEN list_reverse(embedding) ELSE embedding END AS embedding FROM embeddings WHERE label <> 2) SELECT vec_id, round(score, 6) AS score FROM (" + q.cosine("v", "vec_id", "embedding", [(i % 7 - 3) / 3 for i in range(64)]) + ") WHERE score > 0")
def search_vector_table(spark, folder):
    """All vectors are written, those of label 1 replaced by their reverse, those of label 2 removed."""
    rows = load(spark, folder, "embeddings")
    table = search.VectorTable(spark, new_folder(spark, "vectors"), dict(rows.dtypes)["vec_id"]).write(rows, "vec_id", "embedding")
    table.write(rows.filter("label = 1").withColumn("embedding", F.reverse("embedding")), "vec_id", "embedding")
    table.remove(rows.filter("label = 2").select(F.col("vec_id").alias("id")))
    return table.search([(i % 7 - 3) / 3 for i in range(64)]).select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


# Lifecycle

_AGE = f"(epoch(TIMESTAMPTZ '{NOW}+00') - epoch(archived_at)) / 86400"


@query(f"SELECT DISTINCT memory_id, round(least(greatest(100.0 / 3 * pow(0.5, greatest({_AGE}, 0) / 7) + least(coalesce(access_count, 0) / 10.0, 1) * 100 / 3 + coalesce(importance, 0) / 3.0, 0), 100), 4) AS score FROM memories WHERE archived_at IS NOT NULL")
def lifecycle_eviction_score(spark, folder):
    score = lifecycle.eviction_score(F.col("archived_at"), F.col("access_count"), F.col("importance"), NOW)
    return load(spark, folder, "memories").filter("archived_at is not null").select("memory_id", F.round(score, 4).alias("score")).distinct()


@query(f"SELECT DISTINCT memory_id, round(least(greatest(15 * pow(0.5, greatest({_AGE}, 0) / 7) + least(coalesce(access_count, 0) / 10.0, 1) * 15 + 25 + coalesce(importance, 0) * 0.2, 0), 100), 4) AS score FROM memories WHERE archived_at IS NOT NULL")
def lifecycle_scenario_score(spark, folder):
    score = lifecycle.scenario_score("coding", F.col("archived_at"), F.col("access_count"), F.col("importance"), NOW)
    return load(spark, folder, "memories").filter("archived_at is not null").select("memory_id", F.round(score, 4).alias("score")).distinct()


@query(
    f"{_TURNS}, k AS (SELECT session_id, strftime(created_at AT TIME ZONE 'UTC', '%G-W%V') AS week, tokens, tags FROM turns WHERE NOT coalesce({q.chitchat('user_message.text', 'llm_message.text')}, false)), "
    "g AS (SELECT session_id, week, count(*) AS turns, sum(tokens)::BIGINT AS tokens FROM k GROUP BY session_id, week), "
    "a AS (SELECT session_id, week, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT DISTINCT session_id, week, unnest(tags) AS tag FROM k) GROUP BY session_id, week) "
    "SELECT g.session_id, g.week, turns, tokens, tags FROM g JOIN a ON g.session_id IS NOT DISTINCT FROM a.session_id AND g.week IS NOT DISTINCT FROM a.week"
)
def lifecycle_weekly_merge(spark, folder):
    rows = _turns(spark, folder).withColumns({"user_text": F.col("user_message.text"), "llm_text": F.col("llm_message.text")})
    return lifecycle.weekly_merge(rows)


@query(
    f"WITH m AS (SELECT DISTINCT memory_id, session_id, round(least(greatest(100.0 / 3 * pow(0.5, greatest({_AGE}, 0) / 7) + least(coalesce(access_count, 0) / 10.0, 1) * 100 / 3 + coalesce(importance, 0) / 3.0, 0), 100), 4) AS score FROM memories WHERE archived_at IS NOT NULL AND session_id IS NOT NULL) "
    "SELECT memory_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, memory_id) = 1 AS is_main FROM m"
)
def lifecycle_monthly_evict(spark, folder):
    score = lifecycle.eviction_score(F.col("archived_at"), F.col("access_count"), F.col("importance"), NOW)
    files = load(spark, folder, "memories").filter("archived_at is not null and session_id is not null").select("memory_id", "session_id", F.round(score, 4).alias("score")).distinct()
    return lifecycle.monthly_evict(files, ["session_id"]).select("memory_id", "session_id", "is_main")


@query(f"SELECT DISTINCT memory_id, round(least(greatest(25 * pow(0.5, greatest({_AGE}, 0) / 7) + 25 * least(coalesce(access_count, 0) / 10.0, 1) + 0.25 * CASE WHEN length(content) % 3 = 0 THEN 50 ELSE length(content) % 101 END + 0.25 * coalesce(importance, 0), 0), 100), 4) AS score FROM memories WHERE archived_at IS NOT NULL AND content IS NOT NULL")
def lifecycle_topic_score(spark, folder):
    """With a topic's relevance, 50 where its scorer gave none."""
    topic = F.coalesce(F.when(F.length("content") % 3 != 0, F.length("content") % 101), F.lit(50))
    score = lifecycle.eviction_score(F.col("archived_at"), F.col("access_count"), F.col("importance"), NOW, (0.25, 0.25, 0.25, 0.25), topic)
    return load(spark, folder, "memories").filter("archived_at is not null and content is not null").select("memory_id", F.round(score, 4).alias("score")).distinct()


_DAILY = "d AS (SELECT DISTINCT hook_id, session_id, archived_at, summary_title, tags, strftime(archived_at AT TIME ZONE 'UTC', '%G-W%V') AS week FROM hooks WHERE period = 'daily' AND scope = 'session' AND session_id IS NOT NULL AND archived_at IS NOT NULL)"


@query(
    f"""WITH {_DAILY}, o AS (SELECT session_id, week, list(coalesce(summary_title, '') ORDER BY archived_at, hook_id) AS titles, flatten(list(coalesce(tags, []) ORDER BY archived_at, hook_id)) AS tags FROM d GROUP BY session_id, week)
SELECT hook_id, 'weekly/' || session_id || '/' || week AS memory_id, 'Weekly merge (' || len(titles) || ' memories)' AS summary_title, md5('Merged ' || len(titles) || ' daily memories: ' || array_to_string(titles, '; ')) AS abstract, len(titles) AS facts, array_to_string(list_filter(o.tags, lambda x, i: list_position(o.tags, x) = i), ',') AS entities
FROM d JOIN o USING (session_id, week)"""
)
def lifecycle_weekly_hooks(spark, folder):
    rows = load(spark, folder, "hooks").filter("period = 'daily' and scope = 'session' and session_id is not null and archived_at is not null")
    daily = rows.select("hook_id", "session_id", "archived_at", "summary_title", "tags", "memory_id", "period", tx.week_key("archived_at").alias("week")).distinct()
    merged = lifecycle.weekly_hooks(daily, ["session_id", "week"])
    return merged.select("hook_id", "memory_id", "summary_title", F.md5("abstract").alias("abstract"), F.size("key_facts").alias("facts"), F.array_join("key_entities", ",").alias("entities"))


@query(
    f"""{_TURNS}, w AS (SELECT *, session_id || '/' || strftime(created_at AT TIME ZONE 'UTC', '%G-W%V') AS memory_id FROM turns WHERE session_id IS NOT NULL AND created_at IS NOT NULL), f AS (SELECT session_id, memory_id, (sum(tokens) % 1000)::DOUBLE AS score FROM w GROUP BY session_id, memory_id),
m AS (SELECT *, first_value(memory_id) OVER (PARTITION BY session_id ORDER BY score DESC, memory_id) AS main FROM f), k AS (SELECT w.*, m.main, w.memory_id = m.main AS is_main FROM w JOIN m USING (memory_id) WHERE w.memory_id = m.main OR len(list_intersect(tags, [{q.strings(turns.HIGH_VALUE_TAGS)}])) > 0)
SELECT session_id, main, count(*) AS turns, count(*) FILTER (NOT is_main) AS added, sum(tokens)::BIGINT AS tokens, (SELECT string_agg(DISTINCT tag, ',' ORDER BY tag) FROM (SELECT unnest(tags) AS tag FROM k k2 WHERE k2.main = k.main)) AS tags FROM k GROUP BY session_id, main"""
)
def lifecycle_monthly_turns(spark, folder):
    """A session's turns of one ISO week as a weekly file, scored by its tokens modulo 1,000."""
    rows = _turns(spark, folder).filter("session_id is not null and created_at is not null")
    placed = rows.select("session_id", "turn_id", "tokens", "tags", F.concat_ws("/", "session_id", tx.week_key("created_at")).alias("memory_id"))
    files = placed.groupBy("session_id", "memory_id").agg((F.sum("tokens") % 1000).cast("double").alias("score"))
    return lifecycle.merged_months(placed.drop("session_id"), lifecycle.monthly_evict(files, ["session_id"]), ["session_id"])


_HITS = (
    "x AS (SELECT session_id, lower(coalesce(user_message.text, '') || ' ' || coalesce(llm_message.text, '') || ' ') AS text FROM t WHERE session_id IS NOT NULL), s(scenario, place, words) AS (VALUES "
    + ", ".join(f"('{name}', {i}, [{q.strings(words)}])" for i, (name, words) in enumerate(SCENARIO_WORDS.items()))
    + "), c AS (SELECT session_id, scenario, place, count(DISTINCT word) AS hits FROM (SELECT session_id, scenario, place, word, text FROM x, (SELECT scenario, place, unnest(words) AS word FROM s)) WHERE contains(text, word) GROUP BY session_id, scenario, place)"
)


@query(f"WITH {_LATEST_TURNS}, {_HITS} SELECT session_id, scenario, hits FROM c")
def aggregate_scenario_hits(spark, folder):
    return lifecycle.scenario_hits(_said(spark, folder), ["session_id"])


def _said(spark, folder) -> DataFrame:
    rows = _turns(spark, folder).filter("session_id is not null")
    return rows.select("session_id", F.col("user_message.text").alias("user_text"), F.col("llm_message.text").alias("llm_text"))


@query(
    f"WITH {_LATEST_TURNS}, {_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY hits DESC, place) AS k, lead(hits) OVER (PARTITION BY session_id ORDER BY hits DESC, place) AS second FROM c) "
    "SELECT session_id, scenario AS detected, round(hits / (hits + coalesce(second, 0)), 6) AS confidence, CASE WHEN hits / (hits + coalesce(second, 0)) >= 0.6 THEN scenario ELSE 'coding' END AS scenario FROM r WHERE k = 1"
)
def lifecycle_detect_scenario(spark, folder):
    found = lifecycle.detect_scenario(aggregate_scenario_hits(spark, folder), ["session_id"])
    none = F.lit(None).cast("string")
    chosen = lifecycle.resolve_scenario(none, none, F.col("scenario"), F.col("confidence"))
    return found.select("session_id", F.col("scenario").alias("detected"), F.round("confidence", 6).alias("confidence"), chosen.alias("scenario"))


@query("SELECT DISTINCT hook_id, t AS tag, CASE t WHEN 'CodeBlock' THEN 1.0 WHEN 'ToolCall' THEN 0.833333 WHEN 'Thinking' THEN 0.666667 WHEN 'Plan' THEN 0.5 WHEN 'Url' THEN 0.333333 WHEN 'FileAttachment' THEN 0.166667 ELSE 0.0 END::DOUBLE AS priority FROM (SELECT hook_id, unnest(tags) AS t FROM hooks)")
def lifecycle_tag_priority(spark, folder):
    rows = load(spark, folder, "hooks").select("hook_id", F.explode("tags").alias("tag")).distinct()
    return rows.withColumn("priority", F.round(lifecycle.tag_priority(F.col("tag"), "coding"), 6))


@query("SELECT state_id, coalesce(cached_threshold, least(500000, floor(128000 * 0.8)))::BIGINT AS threshold FROM sidecar_state")
def lifecycle_thresholds(spark, folder):
    return load(spark, folder, "sidecar_state").select(
        "state_id", lifecycle.resolve_threshold(F.col("cached_threshold"), F.lit(500_000), F.lit(None).cast("long"), F.lit(128_000)).alias("threshold")
    )


@query("SELECT DISTINCT hook_id, CASE WHEN token_count > 1000 THEN 'high' WHEN token_count > 500 THEN 'medium' ELSE 'low' END AS priority FROM hooks")
def lifecycle_priority_bucket(spark, folder):
    return load(spark, folder, "hooks").select("hook_id", lifecycle.priority_bucket(F.col("token_count")).alias("priority")).distinct()


@query("SELECT vec_id, CASE WHEN score > 0.7 THEN 'full' WHEN score > 0.4 THEN 'summary' ELSE 'keywords' END AS inject FROM (SELECT * FROM (" + q.cosine("embeddings", "vec_id", "embedding", [(i % 7 - 3) / 3 for i in range(64)]) + ") WHERE score > 0 ORDER BY score DESC, vec_id LIMIT 3)")
def lifecycle_inject(spark, folder):
    scores = search.vector_scores(load(spark, folder, "embeddings"), "vec_id", "embedding", [(i % 7 - 3) / 3 for i in range(64)])
    return search.top(scores, 3, "vec_id").select("vec_id", lifecycle.inject_strategy(F.col("score")).alias("inject"))


# Conflicts: the titles of a memory's hooks, in order of archiving, as the facts of its updates. Each title is withdrawn by
# the next update, which also allows what the title names; the one after forbids it, and withdraws that at once.


def _facts(spark, folder):
    rows = load(spark, folder, "hooks").filter("memory_id is not null and summary_title is not null").select("memory_id", "hook_id", "archived_at", "summary_title").distinct()
    numbered = rows.withColumn("s", F.row_number().over(Window.partitionBy("memory_id").orderBy("archived_at", "hook_id", "summary_title")))
    stated = ((0, "added", ""), (1, "deprecated", ""), (1, "added", "allow "), (2, "added", "forbid "), (2, "deprecated", "forbid  "))
    facts = F.explode(F.array(*(F.struct((F.col("s") + n).alias("update_seq"), F.lit(kind).alias("kind"), F.concat(F.lit(before), "summary_title").alias("fact")) for n, kind, before in stated)))
    return numbered.select("memory_id", facts.alias("f")).select("memory_id", "f.*")


_FACTS = """h AS (SELECT DISTINCT memory_id, hook_id, archived_at, summary_title FROM hooks WHERE memory_id IS NOT NULL AND summary_title IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY archived_at, hook_id, summary_title) AS s FROM h),
f AS (SELECT memory_id, s, 'added' AS kind, summary_title AS fact FROM n UNION ALL SELECT memory_id, s + 1, 'deprecated', summary_title FROM n
 UNION ALL SELECT memory_id, s + 1, 'added', 'allow ' || summary_title FROM n UNION ALL SELECT memory_id, s + 2, 'added', 'forbid ' || summary_title FROM n UNION ALL SELECT memory_id, s + 2, 'deprecated', 'forbid  ' || summary_title FROM n)"""


@query(f"WITH {_FACTS} SELECT a.memory_id, a.s AS seq, a.fact AS new_fact, b.fact AS existing_fact FROM f a JOIN f b ON a.memory_id = b.memory_id AND a.kind = 'added' AND b.kind = 'deprecated' AND a.s = b.s WHERE {q.fact_similarity('a.fact', 'b.fact')} >= 0.8")
def conflict_self(spark, folder):
    return conflicts.self_contradictions(_facts(spark, folder)).select("memory_id", "seq", "new_fact", "existing_fact")


@query(f"WITH {_FACTS} SELECT a.memory_id, a.s AS seq, a.fact AS new_fact, b.fact AS existing_fact FROM f a JOIN f b ON a.memory_id = b.memory_id AND a.kind = 'added' AND b.kind = 'added' AND b.s < a.s WHERE {q.opposes('a.fact', 'b.fact')}")
def conflict_direct(spark, folder):
    return conflicts.direct_contradictions(_facts(spark, folder)).select("memory_id", "seq", "new_fact", "existing_fact")


@query(f"WITH {_FACTS} SELECT a.memory_id, a.s AS seq, a.fact AS new_fact, b.fact AS existing_fact FROM f a JOIN f b ON a.memory_id = b.memory_id AND a.kind = 'deprecated' AND b.kind = 'added' AND b.s < a.s WHERE {q.fact_similarity('a.fact', 'b.fact')} >= 0.6")
def conflict_reversal(spark, folder):
    return conflicts.stance_reversals(_facts(spark, folder)).select("memory_id", "seq", "new_fact", "existing_fact")


_DETECTED = f"""{_FACTS}, pairs AS (SELECT a.memory_id, a.s AS seq, a.kind AS kind_a, b.kind AS kind_b, a.fact AS new_fact, b.fact AS existing_fact, b.s AS s FROM f a JOIN f b USING (memory_id)),
found AS (
  SELECT memory_id, seq, 'self' AS conflict, new_fact, existing_fact FROM pairs WHERE kind_a = 'added' AND kind_b = 'deprecated' AND seq = s AND {q.fact_similarity('new_fact', 'existing_fact')} >= 0.8
  UNION ALL SELECT memory_id, seq, 'direct', new_fact, existing_fact FROM pairs WHERE kind_a = 'added' AND kind_b = 'added' AND s < seq AND {q.opposes('new_fact', 'existing_fact')}
  UNION ALL SELECT memory_id, seq, 'reversal', new_fact, existing_fact FROM pairs WHERE kind_a = 'deprecated' AND kind_b = 'added' AND s < seq AND {q.fact_similarity('new_fact', 'existing_fact')} >= 0.6
), detected AS (SELECT *, CASE WHEN conflict = 'direct' THEN 'critical' ELSE 'warning' END AS severity, conflict || ' of ' || new_fact || ' and ' || existing_fact AS description FROM found)"""


@query(f"WITH {_DETECTED} SELECT memory_id, count(*) AS conflicts, count(*) FILTER (severity = 'critical') AS critical, bool_or(severity = 'critical') AS has_critical FROM detected GROUP BY memory_id")
def conflict_summary(spark, folder):
    return conflicts.summary(conflicts.detect(_facts(spark, folder)))


@query(
    f"""WITH {_DETECTED}, r AS (SELECT DISTINCT * FROM detected WHERE conflict <> 'reversal' AND seq % 2 = 0),
o AS (SELECT DISTINCT memory_id, seq, conflict, new_fact, CASE WHEN seq % 3 > 0 THEN upper(existing_fact) END AS existing_fact, 'critical' AS severity, description || ' again' AS description FROM detected WHERE conflict <> 'direct'),
k AS (SELECT o.*, row_number() OVER () AS id FROM o),
m AS (SELECT k.id, k.seq AS o_seq, k.existing_fact AS o_existing, k.description AS o_description, min((r.seq, r.new_fact, r.existing_fact)) AS place, k.memory_id, k.conflict FROM k JOIN r USING (memory_id, conflict)
  WHERE k.new_fact = r.new_fact OR {q.fact_similarity('k.new_fact', 'r.new_fact')} >= 0.7 GROUP BY ALL),
g AS (SELECT memory_id, conflict, place, arg_max(o_description, (length(o_description), o_description)) AS o_description, arg_max(o_existing, (o_seq, o_existing)) FILTER (o_existing IS NOT NULL) AS o_existing FROM m GROUP BY memory_id, conflict, place)
SELECT r.memory_id, r.seq, r.conflict, r.new_fact, coalesce(o_existing, r.existing_fact) AS existing_fact, CASE WHEN g.memory_id IS NULL THEN r.severity ELSE 'critical' END AS severity,
  CASE WHEN length(o_description) > length(r.description) THEN o_description ELSE r.description END AS description
FROM r LEFT JOIN g ON r.memory_id = g.memory_id AND r.conflict = g.conflict AND g.place = (r.seq, r.new_fact, r.existing_fact)
UNION ALL SELECT memory_id, seq, conflict, new_fact, existing_fact, severity, description FROM k WHERE id NOT IN (SELECT id FROM m)"""
)
def conflict_merged_reports(spark, folder):
    """The detector's report on the even updates with a second one that names existing facts in capitals, or none."""
    found = conflicts.detect(_facts(spark, folder))
    second = found.filter("conflict <> 'direct'").withColumns(
        {"existing_fact": F.when(F.col("seq") % 3 > 0, F.upper("existing_fact")), "severity": F.lit("critical"), "description": F.concat("description", F.lit(" again"))}
    )
    return conflicts.merge_reports(found.filter("conflict <> 'reversal' and seq % 2 = 0"), second)


@query(
    f"WITH {_PAIRED_TITLES}, v AS (SELECT DISTINCT 'hook ' || vec_id AS fact, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings), p AS (SELECT 'hook ' || a.vec_id AS a, 'hook ' || (a.vec_id * 3 % 997) AS b FROM embeddings a UNION ALL SELECT a, b FROM pairs) "
    f"SELECT p.a, p.b, round(CASE WHEN u.fact IS NOT NULL AND w.fact IS NOT NULL THEN list_cosine_similarity(u.vector, w.vector) ELSE {q.word_similarity('p.a', 'p.b')} END, 6) AS similarity FROM p LEFT JOIN v u ON u.fact = p.a LEFT JOIN v w ON w.fact = p.b"
)
def conflict_embedding_similarity(spark, folder):
    vectors = load(spark, folder, "embeddings")
    named = lambda c: F.concat(F.lit("hook "), c)
    pairs = vectors.select(named(F.col("vec_id")).alias("a"), named(F.col("vec_id") * 3 % 997).alias("b")).unionByName(_title_pairs(spark, folder).select("a", "b"))
    rows = conflicts.embedding_similarity(pairs, vectors.select(named(F.col("vec_id")).alias("fact"), F.col("embedding").alias("vector")), "a", "b")
    return rows.withColumn("similarity", F.round("similarity", 6))


# Measures

_EVALUATED = "r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, event_type = 'purchase' AS hit FROM events)"
_GAIN = "CASE WHEN {0} <= 1 THEN 1.0 ELSE 1.0 / log2({0}) END"


def _evaluated(spark, folder):
    """Events of a user by value as a ranking, purchases as the right answers."""
    w = Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id")
    events = load(spark, folder, "events")
    return events.select("user_id", "event_id", F.row_number().over(w).alias("rank")).filter("rank <= 50"), events.filter("event_type = 'purchase'").select("user_id", "event_id")


@query(
    f"WITH {_EVALUATED}, k AS (SELECT unnest([1, 3, 5, 10, 30, 50]) AS k), "
    f"m AS (SELECT user_id, k, count(*) FILTER (hit AND rank <= k) AS hits, count(*) FILTER (hit) AS wanted, sum(CASE WHEN hit AND rank <= k THEN {_GAIN.format('rank')} ELSE 0 END) AS dcg FROM r CROSS JOIN k GROUP BY user_id, k) "
    "SELECT user_id, k, (hits > 0)::INTEGER::DOUBLE AS recall_any, (hits = wanted)::INTEGER::DOUBLE AS recall_all, "
    f"round(CASE WHEN wanted = 0 THEN 0 ELSE dcg / list_sum(list_transform(range(1, least(wanted, k) + 1), lambda i: {_GAIN.format('i')})) END, 6)::DOUBLE AS ndcg FROM m"
)
def metric_retrieval(spark, folder):
    rows = metrics.retrieval_metrics(*_evaluated(spark, folder), "user_id", "event_id", [1, 3, 5, 10, 30, 50])
    return rows.withColumn("ndcg", F.round("ndcg", 6))


@query(
    "WITH r AS (SELECT user_id AS session, event_type AS question, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events), b AS (SELECT question, session, min(rank) AS best FROM r GROUP BY question, session) "
    "SELECT question, session, rank FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY best, session) AS rank FROM b) WHERE rank <= 10"
)
def metric_first_sessions(spark, folder):
    w = Window.partitionBy("question").orderBy(F.col("value").desc(), "event_id")
    ranked = load(spark, folder, "events").select(F.col("event_type").alias("question"), F.col("user_id").alias("session"), "value", "event_id").withColumn("rank", F.row_number().over(w))
    return metrics.first_sessions(ranked, "question", "session", 10)


@query(f"WITH {_PAIRED_TITLES} SELECT memory_id, round({q.token_f1('a', 'b')}, 6) AS f1, {q.exact_match('a', 'b')} AS exact FROM pairs")
def metric_token_f1(spark, folder):
    rows = _title_pairs(spark, folder)
    return rows.select("memory_id", F.round(metrics.token_f1(F.col("a"), F.col("b")), 6).alias("f1"), metrics.exact_match(F.col("a"), F.col("b")).alias("exact"))


_PIECES = "list_transform(string_split(replace({0}, ' ', ','), ','), lambda x: trim(x, ' '))"


@query(
    f"WITH {_PAIRED_TITLES}, w AS (SELECT memory_id, replace(a, ' ', ',') AS a, replace(b, ' ', ',') AS b, {_PIECES.format('a')} AS p, {_PIECES.format('b')} AS t FROM pairs), "
    f"f AS (SELECT memory_id, avg(best) AS f1 FROM (SELECT memory_id, i, max({q.token_f1('x', 'y')}) AS best FROM (SELECT memory_id, unnest(p) AS x, i, y FROM (SELECT memory_id, p, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS y FROM w)) GROUP BY memory_id, i) GROUP BY memory_id) SELECT memory_id, round(f1, 6) AS f1 FROM f"
)
def metric_multi_f1(spark, folder):
    """Titles as lists of answers, one a word."""
    rows = _title_pairs(spark, folder).select("memory_id", F.regexp_replace("a", " ", ",").alias("a"), F.regexp_replace("b", " ", ",").alias("b"))
    return rows.select("memory_id", F.round(metrics.multi_f1(F.col("a"), F.col("b")), 6).alias("f1"))


@query(
    f"WITH {_PAIRED_TITLES}, c AS (SELECT *, length(a) % 4 + 2 AS category FROM pairs) SELECT memory_id, category, round(CASE WHEN category = 3 THEN {q.token_f1('a', "string_split(b, ';')[1]")} WHEN category IN (2, 4) THEN {q.token_f1('a', 'b')} "
    "WHEN contains(lower(a), 'no information available') OR contains(lower(a), 'not mentioned') THEN 1.0 ELSE 0.0 END, 6) AS score FROM c"
)
def metric_category_scores(spark, folder):
    rows = _title_pairs(spark, folder).withColumn("category", F.length("a") % 4 + 2)
    return rows.select("memory_id", "category", F.round(metrics.category_score(F.col("category"), F.col("a"), F.col("b")), 6).alias("score"))


@query("WITH s AS (SELECT session_id, list(DISTINCT message_id) AS found FROM compactions GROUP BY session_id) SELECT state_id, session_id, round(CASE WHEN len(processed_message_ids) > 0 THEN len(list_filter(processed_message_ids, lambda x: x IS NOT NULL AND list_contains(found, x))) / len(processed_message_ids)::DOUBLE ELSE 1.0 END, 6) AS recall FROM sidecar_state CROSS JOIN s WHERE session_id IN (SELECT session_id FROM compactions GROUP BY session_id ORDER BY count(*) DESC, session_id LIMIT 3)")
def metric_evidence_recall(spark, folder):
    """Of each state's list the share that the sessions with most compactions, three of them, hold."""
    events = load(spark, folder, "compactions")
    three = events.groupBy("session_id").agg(F.count("*").alias("n"), F.collect_set("message_id").alias("found")).orderBy(F.col("n").desc(), "session_id").limit(3)
    rows = load(spark, folder, "sidecar_state").crossJoin(F.broadcast(three.select("session_id", "found")))  # three rows
    return rows.select("state_id", "session_id", F.round(F.coalesce(metrics.evidence_recall(F.col("processed_message_ids"), F.col("found")), F.lit(1.0)), 6).alias("recall"))


@query("SELECT o_orderpriority, o_orderstatus, round(avg(o_totalprice), 4) AS mean, count(o_totalprice) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderpriority))")
def metric_grouped_means(spark, folder):
    return metrics.accuracy(load(spark, folder, "orders"), "o_totalprice", ["o_orderpriority"], "o_orderstatus")


@query(
    "WITH p AS (SELECT event_id, event_type, md5(concat_ws(':', event_id::VARCHAR, '42')) AS pick FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY pick, event_id) AS k FROM p) "
    "SELECT event_id, event_type FROM k ORDER BY (k > greatest(1, 103 // (SELECT count(DISTINCT event_type) FROM events)))::INTEGER, pick, event_id LIMIT 103"
)
def metric_stratified_sample(spark, folder):
    return metrics.stratified_sample(load(spark, folder, "events"), "event_type", "event_id", 103).select("event_id", "event_type")


@query(
    "WITH r AS (SELECT event_type AS question, user_id AS session_id, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS rank FROM events GROUP BY event_type, user_id), "
    "i AS (SELECT DISTINCT user_id AS session_id FROM events WHERE ts::DATE BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' AND value > 50) "
    "SELECT question, r.session_id, row_number() OVER (PARTITION BY question ORDER BY (i.session_id IS NOT NULL AND question <> 'view') DESC, rank) AS new_rank FROM r LEFT JOIN i USING (session_id)"
)
def metric_date_rerank(spark, folder):
    """Each event type asks for the users' sessions by number of events; all but `view` ask for a range of days."""
    events = load(spark, folder, "events")
    counts = events.groupBy(F.col("event_type").alias("question"), F.col("user_id").alias("session_id")).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy(F.col("n").desc(), "session_id")))
    dates = events.filter("value > 50").select(F.col("user_id").alias("session_id"), F.to_date("ts").alias("day"))
    ranges = events.filter("event_type <> 'view'").select(F.col("event_type").alias("question"), F.lit("2024-01-10").cast("date").alias("start"), F.lit("2024-01-12").cast("date").alias("end")).distinct()
    return metrics.date_range_rerank(ranked, dates, ranges).select("question", "session_id", "new_rank")


# Increments and streams

_ARCHIVED = "a AS (SELECT session_id, max(seq) AS last_seq FROM (SELECT unnest(map_entries(last_archived_seq)).key AS session_id, unnest(map_entries(last_archived_seq)).value AS seq FROM sidecar_state) GROUP BY session_id)"


@query(f"WITH {_MESSAGES}, {_ARCHIVED} SELECT session_id, sum(tokens)::BIGINT AS tokens, max(seq) AS last_seq FROM (SELECT m.session_id, m.seq, {q.tokens('text')} AS tokens FROM messages m LEFT JOIN a USING (session_id) WHERE m.seq > coalesce(a.last_seq, -1)) GROUP BY session_id HAVING sum(tokens) > 0")
def increment_pending_tokens(spark, folder):
    rows = _messages(spark, folder).select("session_id", "seq", "tokens")
    return increments.pending_tokens(rows, increments.last_archived(load(spark, folder, "sidecar_state")))


@query(f"WITH {_MESSAGES}, {_ARCHIVED} SELECT session_id, sum(tokens)::BIGINT AS tokens FROM (SELECT m.session_id, {q.tokens('text')} AS tokens FROM messages m LEFT JOIN a USING (session_id) WHERE m.seq > coalesce(a.last_seq, -1)) GROUP BY session_id HAVING sum(tokens) >= 800")
def increment_due_sessions(spark, folder):
    return increments.due_sessions(increment_pending_tokens(spark, folder), 1000, 80).select("session_id", "tokens")


@query("SELECT delivery_id FROM compactions WHERE message_id IS NULL OR message_id NOT IN (SELECT id FROM (SELECT unnest(processed_message_ids) AS id FROM sidecar_state) WHERE id IS NOT NULL)")
def increment_unprocessed(spark, folder):
    return increments.unprocessed(load(spark, folder, "compactions"), load(spark, folder, "sidecar_state"), "message_id").select("delivery_id")


@query(f"WITH {_ARCHIVED} SELECT m.id, m.received_at FROM session_messages m JOIN a USING (session_id) WHERE m.seq > a.last_seq AND m.type <> 'compaction'")
def increment_between(spark, folder):
    ranges = increments.last_archived(load(spark, folder, "sidecar_state")).select("session_id", F.col("last_seq").alias("low"), F.lit(None).cast("long").alias("high"))
    return increments.between(load(spark, folder, "session_messages"), ranges).select("id", "received_at")


@query(f"WITH {_ARCHIVED}, r AS (SELECT m.id, m.received_at, m.seq, m.session_id FROM session_messages m JOIN a USING (session_id) WHERE m.seq > a.last_seq AND m.type <> 'compaction') SELECT id, n FROM (SELECT id, row_number() OVER (PARTITION BY session_id ORDER BY seq, id) AS n FROM r) WHERE n <= 2")
def increment_first_of_range(spark, folder):
    ranges = increments.last_archived(load(spark, folder, "sidecar_state")).select("session_id", F.col("last_seq").alias("low"), F.lit(None).cast("long").alias("high"))
    return increments.first_of_range(load(spark, folder, "session_messages"), ranges, 2).select("id", "n")


@query("WITH f AS (SELECT source, CASE WHEN source = 'chat' OR starts_with(source, 'chat-') THEN 'talk' WHEN regexp_matches(source, '^archive/[a-z]+(-|$)') THEN 'archive' ELSE 'custom' END AS family FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)) SELECT family, count(*) AS sessions, array_to_string(list(source ORDER BY source)[:10], ',') AS first FROM f GROUP BY family")
def increment_families(spark, folder):
    """Sources of documents as sessions; the archives' names up to a dash as the prefixes of one family."""
    sources = load(spark, folder, "documents").select(F.col("source").alias("session_id")).filter("session_id is not null").distinct()
    archives = sources.select(F.regexp_extract("session_id", "^(archive/[a-z]+)(-|$)", 1).alias("prefix")).filter("prefix <> ''").distinct()
    families = archives.withColumn("family", F.lit("archive")).unionByName(spark.createDataFrame([("chat", "talk")], "prefix string, family string"))
    return increments.by_family(sources, families)


@query(
    f"WITH {_MESSAGES}, u AS (SELECT m.session_id, m.id, s.time_created FROM messages m JOIN (SELECT id, max(time_created) AS time_created FROM session_messages GROUP BY id) s USING (id) WHERE role = 'user'), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY time_created DESC NULLS LAST, id DESC) AS n FROM u) SELECT session_id, arg_max(id, n) AS id FROM r WHERE n <= 3 GROUP BY session_id"
)
def increment_tail_start(spark, folder):
    times = load(spark, folder, "session_messages").groupBy("id").agg(F.max("time_created").alias("time_created"))
    return turns.tail_start(_messages(spark, folder).join(times, "id"), 3)


@query("SELECT session_id, seq, 'System: compaction summary (reason=' || coalesce(reason, '') || ')' AS user_text, md5(coalesce(summary, '') || chr(10) || chr(10) || '--- Recent Context ---' || chr(10) || coalesce(recent, '')) AS digest FROM compactions")
def increment_compaction_turns(spark, folder):
    rows = turns.compaction_turns(load(spark, folder, "compactions"))
    return rows.select("session_id", "seq", "user_text", F.md5("llm_text").alias("digest"))


@query(
    "WITH c AS (SELECT DISTINCT message_id, session_id, time_created, reason, summary FROM compactions WHERE message_id IS NOT NULL) SELECT message_id || ':user' AS id, session_id, 'user' AS role, time_created, reason AS text FROM c UNION ALL SELECT message_id || ':assistant', session_id, 'assistant', time_created + 1, summary FROM c"
)
def increment_compaction_messages(spark, folder):
    events = load(spark, folder, "compactions").filter("message_id is not null").select("message_id", "session_id", "time_created", "reason", "summary").distinct()
    rows = turns.compaction_messages(events)
    return rows.select("id", "session_id", "role", "time_created", F.get_json_object("data", "$.content[0].text").alias("text"))


@query("SELECT session_id, count(*) AS messages, max(seq) AS last_seq FROM session_messages WHERE session_id IS NOT NULL GROUP BY session_id")
def stream_session_totals(spark, folder):
    path = f"{folder}/session_messages.parquet"
    return totals.follow_totals(spark, path, spark.read.parquet(path).schema)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark, folder):
    path = f"{folder}/events.parquet"
    return totals.follow_windows(spark, path, spark.read.parquet(path).schema, "ts", "1 day", ["event_type"])


@query("SELECT delivery_id, message_id FROM compactions")
def stream_backfill(spark, folder):
    """History followed like new events; a first call without backfill marks it as seen, and adds no rows."""
    path = f"{folder}/compactions.parquet"
    schema = spark.read.parquet(path).schema
    for backfill in (False, True):
        out, checkpoint = new_folder(spark, "followed"), totals.checkpoint_for(new_folder(spark, "checkpoint"), "v2")
        rows = totals.follow_events(spark, path, schema, out, checkpoint, backfill=backfill).select("delivery_id", "message_id")
        followed = rows if not backfill else followed.unionByName(rows)
    return followed


@query(f"SELECT session_id, tokens, last_seq FROM (SELECT session_id, sum({q.tokens('data')})::BIGINT AS tokens, max(seq) AS last_seq FROM session_messages WHERE session_id IS NOT NULL GROUP BY session_id) WHERE tokens >= 400")
def stream_token_thresholds(spark, folder):
    """All files in one micro-batch, so that each session has one event at most."""
    path = f"{folder}/session_messages.parquet"
    found = totals.follow_thresholds(spark, path, spark.read.parquet(path).schema, tx.estimate_tokens("data"), 400, new_folder(spark, "thresholds"), new_folder(spark, "checkpoint"), max_files=100_000)
    return found.select("session_id", "tokens", "last_seq")


@query(
    r"""
WITH d AS (
  SELECT delivery_id, received_at, nullif(lower(regexp_replace(message_id, '^\s+|\s+$', '', 'g')), '') AS k FROM compactions
), listed AS (
  SELECT nullif(lower(regexp_replace(id, '^\s+|\s+$', '', 'g')), '') AS k, min(saved_at) AS saved_at
  FROM (SELECT saved_at, unnest(processed_message_ids) AS id FROM sidecar_state) GROUP BY 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY received_at, delivery_id) AS n FROM d WHERE k IS NOT NULL
)
SELECT delivery_id FROM ranked LEFT JOIN listed USING (k) WHERE n > 1 OR saved_at < received_at
"""
)
def p6_found(spark, folder):
    """Deliveries to drop."""
    return repeated_deliveries(load(spark, folder, "compactions"), load(spark, folder, "sidecar_state"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Hybrid search over documents and vectors."""
    return search_hybrid(spark, folder)
