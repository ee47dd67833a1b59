"""Conversations from plain text and from message payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TURN = "array<struct<user_message:struct<text:string>,llm_message:struct<text:string>>>"


def parse_context(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, turn, user_text, llm_text) from a JSON array of turns, or lines that begin with `User:` or `Assistant:`.

    Turns without any text are left out; other texts give no rows. Lines belong
    to the mark before them.
    """
    rows = df.select(id_col, F.col(text_col).alias("__text")).filter("__text is not null")
    is_json = F.ltrim("__text").startswith("[")
    parsed = rows.filter(is_json).select(id_col, F.posexplode(F.from_json("__text", _TURN)).alias("at", "t"))
    from_json = parsed.select(id_col, (F.col("at") + 1).cast("long").alias("turn"), F.col("t.user_message.text").alias("user_text"), F.col("t.llm_message.text").alias("llm_text"))
    from_json = from_json.filter("coalesce(user_text, '') <> '' or coalesce(llm_text, '') <> ''")
    mark = F.regexp_extract("line", r"^\s*(User|Assistant|Human|AI):", 1)
    lines = rows.filter(~is_json).select(id_col, F.posexplode(F.split("__text", r"\r?\n")).alias("at", "line")).withColumn("mark", mark)
    w = Window.partitionBy(id_col).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("turn", F.sum(F.when(F.col("mark").isin("User", "Human"), 1).otherwise(0)).over(w))
    lines = lines.withColumn("speaker", F.last(F.when(F.col("mark") != "", F.col("mark")), True).over(w)).filter("speaker is not null")
    body = F.regexp_replace("line", r"^\s*(User|Assistant|Human|AI):\s*", "")
    text = lambda *who: F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("speaker").isin(*who), F.struct("at", body.alias("b"))))), lambda x: x["b"]), "\n"))
    marked = lines.groupBy(id_col, "turn").agg(text("User", "Human").alias("user_text"), text("Assistant", "AI").alias("llm_text"))
    return from_json.unionByName(marked.filter("user_text <> '' or llm_text <> ''"))


_PARTS = "array<struct<type:string,text:string,tokens:struct<input:bigint,output:bigint,reasoning:bigint>,reason:string,cost:double>>"


def _parts(v: str) -> Column:
    """The content parts of the variant column `v`; none if it has no such list."""
    return F.coalesce(F.expr(f"try_variant_get({v}, '$.content', '{_PARTS}')"), F.expr(f"transform(try_variant_get({v}, '$.content', 'array<struct<type:string,text:string>>'), p -> named_struct('type', p.type, 'text', p.text, 'tokens', null, 'reason', null, 'cost', null))").cast(_PARTS), F.array().cast(_PARTS))


def _joined(parts: Column, kind: str, sep: str) -> Column:
    return F.array_join(F.transform(F.filter(parts, lambda p: (p["type"] == kind) & p["text"].isNotNull()), lambda p: p["text"]), sep)


def payload_text(v: str) -> Column:
    """Text of a message in the variant column `v`: its own, else all parts of type text, one a line; reasoning does not count."""
    return F.coalesce(F.expr(f"try_variant_get({v}, '$.text', 'string')"), _joined(_parts(v), "text", "\n"))


def payload_tokens(v: str) -> Column:
    """Input, output and reasoning tokens of the last finished step, or null."""
    steps = F.filter(_parts(v), lambda p: (p["type"] == "step-finish") & p["tokens"].isNotNull())
    last = F.element_at(steps, -1)["tokens"]
    return F.when(F.size(steps) > 0, sum((F.coalesce(last[x], F.lit(0)) for x in ("input", "output", "reasoning")), F.lit(0).cast("long")))


def _last_of_steps(v: str, name: str) -> Column:
    steps = F.filter(_parts(v), lambda p: (p["type"] == "step-finish") & p[name].isNotNull())
    return F.when(F.size(steps) > 0, F.element_at(steps, -1)[name])


def payload_finish(v: str) -> Column:
    """The reason of the last finished step, else that of the message."""
    return F.coalesce(_last_of_steps(v, "reason"), F.expr(f"try_variant_get({v}, '$.finish', 'string')"))


def payload_cost(v: str) -> Column:
    return F.coalesce(_last_of_steps(v, "cost"), F.expr(f"try_variant_get({v}, '$.cost', 'double')"))


def parse_payloads(messages: DataFrame) -> DataFrame:
    """(id, received_at, text, reasoning, tools, tokens, finish, cost) of JSON message payloads; damaged ones have nulls."""
    v = F.expr("try_parse_json(data)")
    rows = messages.select("id", "received_at", v.alias("v"))
    parts = _parts("v")
    return rows.select(
        "id", "received_at",
        payload_text("v").alias("text"),
        _joined(parts, "reasoning", "\n\n").alias("reasoning"),
        F.size(F.filter(parts, lambda p: p["type"] == "tool")).alias("tools"),
        payload_tokens("v").alias("tokens"),
        payload_finish("v").alias("finish"),
        payload_cost("v").alias("cost"),
    )
