"""Turns: pairing of messages, tags, token totals, batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, is_question, is_subagent_tool
from ..vocab import HIGH_VALUE_TAGS
from . import sequences


def message_tags(m: str, attachments: bool = False) -> Column:
    """Tags of one message struct, in the order of the rules that give them; with `attachments` it has a list of them with a kind."""
    text, tools = F.coalesce(F.col(f"{m}.text"), F.lit("")), F.col(f"{m}.tool_calls")
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    filled = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    has_kind = lambda k: F.coalesce(F.exists(f"{m}.attachments", lambda a: F.lower(a["kind"]) == k.lower()), F.lit(False))
    fence = text.contains("```")
    code = fence | some(F.col(f"{m}.file_changes"))
    tags = F.array_compact(
        F.array(
            F.when(some(tools), "ToolCall"),
            F.when(some(tools), "AgentTool"),
            F.when(F.coalesce(F.exists(tools, lambda t: F.coalesce(is_subagent_tool(t["name"]), F.lit(False))), F.lit(False)), "SubAgent"),
            *([F.when(has_kind(k), t) for k, t in (("Image", "Image"), ("Video", "Video"), ("Voice", "Voice"), ("File", "FileAttachment"))] if attachments else []),
            F.when(code, "CodeBlock"),
            F.when(filled(F.col(f"{m}.thinking")), "Thinking"),
            F.when(text.contains("http://") | text.contains("https://"), "Url"),
            F.when(is_question(text) & ~code, "Question"),
        )
    )
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("Text")))


def turn_tags(user: str = "user_message", answer: str = "llm_message", attachments: bool = False) -> Column:
    """Both messages' tags, first seen first, without Text if there is another."""
    both = F.array_distinct(F.concat(message_tags(user, attachments), message_tags(answer, attachments)))
    rest = F.array_remove(both, "Text")
    return F.when(F.size(rest) > 0, rest).otherwise(both)


def message_tokens(m: str, tool_names: bool = True, least: int = 1) -> Column:
    """Estimates of text, thinking and tool calls, at least `least`."""
    one = lambda t: (
        (estimate_tokens(t["name"]) if tool_names else F.lit(0).cast("long")) + estimate_tokens(t["arguments"]) + estimate_tokens(t["result"])
    )
    tools = F.aggregate(F.coalesce(F.transform(f"{m}.tool_calls", one), F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda s, x: s + x)
    total = estimate_tokens(f"{m}.text") + estimate_tokens(f"{m}.thinking") + tools
    return F.greatest(total, F.lit(least).cast("long"))


def turn_tokens() -> Column:
    return message_tokens("user_message") + message_tokens("llm_message")


def estimated_turn_tokens() -> Column:
    """By an estimator: without the tools' names, at least 1 a turn."""
    return F.greatest(message_tokens("user_message", False, 0) + message_tokens("llm_message", False, 0), F.lit(1).cast("long"))


def is_high_value(tags: Column) -> Column:
    return F.arrays_overlap(tags, F.array(*(F.lit(t) for t in HIGH_VALUE_TAGS)))


SPEAKERS = ("user", "assistant")
#: Roles that belong to no turn; any other but assistant opens one, as user does.
SILENT = ("system", "synthetic", "shell", "compaction")


def number_turns(messages: DataFrame) -> DataFrame:
    """Adds turn: the number of user messages up to each row, in order of seq, then id; silent roles are left out.

    Columns session_id, seq, id, role. A leading assistant is turn 0. A session
    may fill any number of tasks.
    """
    rows = messages.filter(~F.coalesce(F.col("role"), F.lit("")).isin(*SILENT))
    cut = sequences.stretches(rows, "session_id", ["seq", "id"])
    opens = F.when(F.coalesce(F.col("role"), F.lit("")) == "assistant", 0).otherwise(1).cast("long")
    return sequences.running_sum(cut, "session_id", ["seq", "id"], opens, "turn").drop(sequences.PART)


def pair_turns(messages: DataFrame) -> DataFrame:
    """(session_id, turn, user_text, llm_text, tokens, stop_reason, cost, messages) of each turn.

    A user message opens a turn; the answers up to the next one are merged:
    texts that are not empty joined by an empty line, tokens summed (null where
    no answer has any), of stop reason and cost the last one that is not null.
    Only whole turns are gathered into one row.
    Columns id, session_id, seq, role, text, tokens, finish, cost.
    """
    answer = F.coalesce(F.col("role"), F.lit("")) == "assistant"
    at = F.struct("seq", "id")
    rows = number_turns(messages)
    said = F.collect_list(F.when(answer & (F.coalesce("text", F.lit("")) != ""), F.struct("seq", "id", "text")))
    last = lambda c: F.max_by(c, F.when(answer & F.col(c).isNotNull(), at))
    return rows.groupBy("session_id", "turn").agg(
        F.max(F.when(~answer, F.col("text"))).alias("user_text"),
        F.array_join(F.transform(F.array_sort(said), lambda x: x["text"]), "\n\n").alias("llm_text"),
        F.sum(F.when(answer, F.col("tokens"))).alias("tokens"),
        last("finish").alias("stop_reason"),
        last("cost").alias("cost"),
        F.count("*").alias("messages"),
    )


def _with_next(messages: DataFrame) -> DataFrame:
    rows = messages.filter(F.col("role").isin(*SPEAKERS))
    return sequences.neighbour(sequences.stretches(rows, "session_id", ["seq", "id"]), "session_id", ["seq", "id"], ["role", "text"])


def strict_pairs(messages: DataFrame) -> DataFrame:
    """(session_id, seq, user_text, llm_text): user messages that an assistant follows at once."""
    rows = _with_next(messages).filter("role = 'user' and __next.role = 'assistant'")
    return rows.select("session_id", "seq", F.col("text").alias("user_text"), F.col("__next.text").alias("llm_text"))


def lenient_pairs(messages: DataFrame) -> DataFrame:
    """(session_id, seq, user_text, llm_text): as strict_pairs, and every message without partner as a pair with an empty side.

    An assistant belongs to a user message right before it. Pairs without any text are left out.
    """
    rows = _with_next(messages)
    led = sequences.neighbour(rows.drop("__next"), "session_id", ["seq", "id"], ["role"], after=False)
    users = rows.filter("role = 'user'").select("session_id", "seq", F.col("text").alias("user_text"), F.when(F.col("__next.role") == "assistant", F.col("__next.text")).alias("llm_text"))
    alone = led.filter("role = 'assistant' and coalesce(__next.role, '') <> 'user'").select("session_id", "seq", F.lit("").alias("user_text"), F.col("text").alias("llm_text"))
    pairs = users.unionByName(alone).select("session_id", "seq", F.coalesce("user_text", F.lit("")).alias("user_text"), F.coalesce("llm_text", F.lit("")).alias("llm_text"))
    return pairs.filter("user_text <> '' or llm_text <> ''")


def speaker_pairs(lines: DataFrame, first: str, key: str = "session_id", speaker: str = "speaker") -> DataFrame:
    """(key, seq, user_text, llm_text): each line of the speaker `first` with the line of another one right after it, empty where `first` goes on."""
    cut = sequences.stretches(lines.select(key, "seq", "id", F.col(speaker).alias("speaker"), "text"), key, ["seq", "id"])
    rows = sequences.neighbour(cut, key, ["seq", "id"], ["speaker", "text"]).filter(F.col("speaker") == first)
    reply = F.when(F.col("__next.speaker") != first, F.col("__next.text"))
    return rows.select(key, "seq", F.col("text").alias("user_text"), F.coalesce(reply, F.lit("")).alias("llm_text"))


def rounds(turns: DataFrame) -> DataFrame:
    """Each turn with the text of the next one of its session."""
    cut = sequences.stretches(turns, "session_id", ["turn"])
    return sequences.neighbour(cut, "session_id", ["turn"], ["user_text"]).withColumn("next_user_text", F.col("__next.user_text")).drop("__next", sequences.PART)


def keep_recent(rows: DataFrame, n: int, key: str = "session_id", order: str = "seq", oldest: bool = False) -> DataFrame:
    """The n latest (or oldest) rows of each key."""
    by = F.col(order).asc() if oldest else F.col(order).desc()
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(by, "id"))).filter(F.col("__n") <= n).drop("__n")


def within_budget(rows: DataFrame, budget: int, key: str = "session_id", order: str = "seq", tokens: str = "tokens") -> DataFrame:
    """The latest rows of each key whose tokens together stay within the budget; adds used, their sum so far."""
    by = [F.col(order).desc(), F.col("id").asc()]
    return sequences.running_sum(sequences.stretches(rows, key, by), key, by, F.col(tokens), "used").filter(F.col("used") <= budget).drop(sequences.PART)


_SUMMARY = "session_id string, part long, places array<double>, cuts array<long>, carries array<double>, total double"


def _first_reach(sums: np.ndarray, start: np.ndarray, threshold: float) -> np.ndarray:
    """For each start (index into sums, which begin with 0) the first index whose sum lies the threshold beyond; past the end if none does."""
    return np.maximum(np.searchsorted(sums, sums[start] + threshold, "left"), start + 1)


def batch_turns(turns: DataFrame, threshold: int, factor: float = 1.5) -> DataFrame:
    """(session_id, batch, batch_tokens, turns, truncated): the batches of number_batches, marked truncated from `factor` times the threshold on."""
    numbered = number_batches(turns, threshold)
    totals = numbered.groupBy("session_id", "batch").agg(F.sum("tokens").cast("long").alias("batch_tokens"), F.count("*").alias("turns"))
    return totals.withColumn("truncated", F.col("batch_tokens") >= F.lit(threshold * factor))


def number_batches(turns: DataFrame, threshold: int) -> DataFrame:
    """(session_id, turn_id, batch, tokens): turns cut into batches at the threshold.

    A batch is closed by the turn that brings its tokens to the threshold, and
    the next begins at 0. Columns turn_id, session_id, tokens (null counts as
    0), created_at; null sessions are one.

    Where a batch begins depends on all turns before, but within a stretch only
    on the tokens carried into it: each stretch is summed up as a step function
    from those to the batches closed and the tokens carried on. The summaries of
    a session, one a stretch, are passed through in order, and each stretch is
    then numbered by what is carried into it.
    """
    order = ["created_at", "turn_id"]
    rows = turns.select("session_id", "turn_id", F.coalesce("tokens", F.lit(0)).cast("double").alias("tokens"), "created_at")
    cut = sequences.stretches(rows, "session_id", order)

    def sum_up(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens, out = pdf["tokens"].to_numpy(), []
        for a, b in _edges(pdf, "session_id", sequences.PART):
            sums = np.concatenate([[0.0], np.cumsum(tokens[a:b])])
            n = b - a
            reach = _first_reach(sums, np.arange(n + 1), threshold).tolist()
            closed, carried = [0] * (n + 1), [0.0] * (n + 1)
            for i in range(n, -1, -1):  # what follows from a batch that begins after row i
                if reach[i] > n:
                    carried[i] = float(sums[n] - sums[i])
                else:
                    closed[i], carried[i] = closed[reach[i]] + 1, carried[reach[i]]
            # with c carried in, the first batch ends at the first row where sums >= threshold - c
            last = min(int(np.searchsorted(sums[1:], threshold, "left")) + 1, n)
            out.append((pdf["session_id"].iat[a], pdf[sequences.PART].iat[a], sums[1 : last + 1].tolist(), [c + 1 for c in closed[1 : last + 1]], carried[1 : last + 1], float(sums[n])))
        return pd.DataFrame(out, columns=["session_id", "part", "places", "cuts", "carries", "total"])

    def pass_on(pdf: pd.DataFrame) -> pd.DataFrame:
        carries, numbers = np.zeros(len(pdf)), np.zeros(len(pdf), np.int64)
        for a, b in _edges(pdf, "session_id"):
            carry, number = 0.0, 0
            for k in range(a, b):
                carries[k], numbers[k] = carry, number
                places = pdf["places"].iat[k]
                at = int(np.searchsorted(places, threshold - carry, "left"))
                if at < len(places):
                    number, carry = number + int(pdf["cuts"].iat[k][at]), float(pdf["carries"].iat[k][at])
                else:
                    carry += pdf["total"].iat[k]
        return pdf[["session_id", "part"]].assign(carry=carries, number=numbers)

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens, batch = pdf["tokens"].to_numpy(), np.zeros(len(pdf), np.int64)
        carries, numbers = pdf["carry"].to_numpy(), pdf["number"].to_numpy()
        for a, b in _edges(pdf, "session_id", sequences.PART):
            sums = np.concatenate([[0.0], np.cumsum(tokens[a:b])])
            at, number, to = 0, int(numbers[a]), max(int(np.searchsorted(sums, threshold - carries[a], "left")), 1)
            while at < b - a:
                batch[a + at : a + to] = number
                number, at = number + 1, to
                if at < b - a:
                    to = int(_first_reach(sums, np.array([at]), threshold)[0])
            # a batch that goes on beyond the stretch ends with it
        return pdf[["session_id", "turn_id"]].assign(batch=batch, tokens=tokens)

    keys = ["session_id", sequences.PART]
    summaries = _in_partitions(cut, keys, [*keys, *order], sum_up, _SUMMARY)
    carried = _in_partitions(summaries, ["session_id"], ["session_id", "part"], pass_on, "session_id string, part long, carry double, number long")
    entered = cut.join(carried.withColumnRenamed("session_id", "__key"), cut["session_id"].eqNullSafe(F.col("__key")) & (cut[sequences.PART] == F.col("part"))).drop("__key", "part")
    return _in_partitions(entered, keys, [*keys, *order], assign, f"session_id string, turn_id {dict(turns.dtypes)['turn_id']}, batch long, tokens double")


def _in_partitions(df: DataFrame, keys: list[str], order: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """`f` over partitions that hold whole keys, sorted; Spark fits their size to its advisory one, and a key is a stretch or a row a stretch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            yield f(pd.concat(parts, ignore_index=True))

    return df.repartition(*keys).sortWithinPartitions(*order).mapInPandas(run, schema)


def _edges(pdf: pd.DataFrame, *keys: str) -> list[tuple[int, int]]:
    """Begin and end of each run of equal keys; nulls are equal."""
    new = np.zeros(len(pdf), bool)
    new[0] = True
    for k in keys:
        codes = pd.factorize(pdf[k])[0]
        new[1:] |= codes[1:] != codes[:-1]
    begin = np.flatnonzero(new)
    return list(zip(begin.tolist(), [*begin[1:].tolist(), len(pdf)]))


def turns_text(turns: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, text): what is said in the turns, users and answers in order, blank texts left out, joined by blanks; no thinking, no tools.

    A key's whole text becomes one value, as an index entry needs it: keys are those of memories, whose size the batch threshold bounds.
    """
    filled = lambda m: F.when(F.trim(f"{m}.text") != "", F.col(f"{m}.text"))
    said = F.concat_ws(" ", filled("user_message"), filled("llm_message"))
    rows = turns.select(*keys, F.struct(*order, said.alias("said")).alias("t")).filter("t.said <> ''")
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["said"]), " ").alias("text"))


def tail_start(messages: DataFrame, turns: int) -> DataFrame:
    """(session_id, id): the user message with which a session's last `turns` turns begin, its first message of a user if there are fewer; by time, ties by id."""
    users = messages.filter(F.col("role") == "user")
    w = Window.partitionBy("session_id").orderBy(F.col("time_created").desc(), F.col("id").desc())
    last = users.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= turns)
    return last.groupBy("session_id").agg(F.max_by("id", "n").alias("id"))


def compaction_turns(events: DataFrame) -> DataFrame:
    """(session_id, seq, user_text, llm_text): the made turn that stands for each compaction, after the session's turns: why it came, its summary and what was kept."""
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    return events.select(
        "session_id",
        "seq",
        F.concat(F.lit("System: compaction summary (reason="), part("reason"), F.lit(")")).alias("user_text"),
        F.concat(part("summary"), F.lit("\n\n--- Recent Context ---\n"), part("recent")).alias("llm_text"),
    )


def compaction_messages(events: DataFrame) -> DataFrame:
    """(id, session_id, role, time_created, data): for a chat database, a user's mark and the assistant's summary of each compaction."""
    mark = F.to_json(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("compaction").alias("type"), F.col("reason").alias("text"))).alias("content")))
    told = F.to_json(F.struct(F.lit("assistant").alias("role"), F.lit(True).alias("summary"), F.array(F.struct(F.lit("text").alias("type"), F.col("summary").alias("text"))).alias("content")))
    both = F.array(F.struct(F.lit("user").alias("role"), mark.alias("data"), F.lit(0).alias("later")), F.struct(F.lit("assistant").alias("role"), told.alias("data"), F.lit(1).alias("later")))
    rows = events.select("message_id", "session_id", "time_created", F.explode(both).alias("m"))
    return rows.select(F.concat_ws(":", "message_id", "m.role").alias("id"), "session_id", "m.role", (F.col("time_created") + F.col("m.later")).alias("time_created"), "m.data")
