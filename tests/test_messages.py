"""Messages of several content parts in the queries over turns, budgets, distances and pending tokens."""

import datetime as dt
import json

import pytest

import mnemospark.plans.queries as plans


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("messages"))
    part = lambda kind, text: {"type": kind, "text": text}
    t = dt.datetime(2025, 1, 1)
    asked = {"content": [part("text", "Why is"), part("text", "it slow?")]}
    said = {"content": [part("reasoning", "think " * 900), part("text", "The index"), part("tool", "x"), part("text", "was lost.")]}
    rows = [("m1", "s", "user", 1, json.dumps(asked), t), ("m2", "s", "assistant", 2, json.dumps(said), t), ("m3", "s", "user", 3, '{"text": "ok"}', t), ("m4", "s", "assistant", 4, '{"content": [{"type": "reasoning", "text": "x"}]}', t), ("m5", "s", "user", 5, '{"text": "cut', t)]
    spark.createDataFrame(rows, "id string, session_id string, type string, seq long, data string, received_at timestamp").write.parquet(f"{path}/session_messages.parquet")
    spark.createDataFrame([], "last_archived_seq map<string,bigint>").write.parquet(f"{path}/sidecar_state.parquet")
    return path


def test_all_text_parts_count_and_no_reasoning(spark, folder):
    texts = {r["id"]: r["text"] for r in plans._messages(spark, folder).collect()}
    assert texts == {"m1": "Why is\nit slow?", "m2": "The index\nwas lost.", "m3": "ok", "m4": "", "m5": ""}


def test_queries_over_messages(spark, folder):
    run = lambda name: plans.QUERIES[name](spark, folder).collect()
    pair = ("Why is\nit slow?", "The index\nwas lost.")
    assert pair in {(r["user_text"], r["llm_text"]) for r in run("window_pair_turns")}
    assert pair in {(r["user_text"], r["llm_text"]) for r in run("window_strict_pairs")}
    assert {r["id"] for r in run("window_token_budget")} == {"m1", "m2", "m3", "m4", "m5"}
    assert max(r["distance"] for r in run("aggregate_distance_buckets")) == len("".join(pair)) + 2
    assert [r["tokens"] < 50 for r in run("increment_pending_tokens")] == [True]
    assert run("increment_due_sessions") == []


def test_between_has_no_fixed_end(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    rows = [("a", "s", "user", 5, t), ("b", "s", "user", 1_700_000_000_000, t), ("c", "s", "compaction", 1_700_000_000_001, t), ("d", "s", "user", 2, t)]
    spark.createDataFrame(rows, "id string, session_id string, type string, seq long, received_at timestamp").write.parquet(f"{tmp_path}/session_messages.parquet")
    spark.createDataFrame([({"s": 2},)], "last_archived_seq map<string,bigint>").write.parquet(f"{tmp_path}/sidecar_state.parquet")
    assert {r["id"] for r in plans.QUERIES["increment_between"](spark, str(tmp_path)).collect()} == {"a", "b"}
