"""Cases worked out by hand."""

import datetime as dt
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import text as tx
from mnemospark.functions.stems import stem
from mnemospark.operators import conflicts, increments, keyword, lifecycle, metrics, search, sequences, storage, turns
from mnemospark.sources import packed
from mnemospark.sources.context import parse_context
from mnemospark.streaming import deliveries, totals
from mnemospark.streaming.deliveries import keep_one_delivery, repeated_deliveries

T0 = dt.datetime(2025, 1, 1)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def both(spark, f, a, b):
    return value(spark, f(F.lit(a), F.lit(b)))


def test_similarity_levels(spark):
    s = lambda a, b: both(spark, tx.fact_similarity, a, b)
    assert s(" Coffee", "coffee ") == 1.0
    assert s("user loves coffee", "coffee") == 0.9
    assert s("", "x") == 0.0
    assert s("user loves coffee", "user hates coffee") > 0.4
    assert s("alpha beta", "gamma delta") < 0.2


def test_opposites(spark):
    o = lambda a, b: both(spark, tx.opposes, a, b)
    assert o("我喜欢咖啡", "我不喜欢咖啡") and o("我不喜欢咖啡", "我喜欢咖啡")
    assert not o("我喜欢咖啡", "我喜欢茶")


def test_token_estimates(spark):
    assert value(spark, tx.estimate_tokens(F.lit("カタカナ"))) == 6
    assert value(spark, tx.estimate_tokens(F.lit(None).cast("string"))) == 0
    assert value(spark, tx.char_tokens(F.lit("ab 中!"))) == 2 + 1 + 1


@pytest.mark.parametrize("user, answer, expected", [("你好", "x", True), ("谢谢", "", True), ("", "", True), ("please design the schema of it", "x", False), ("ok", "done", True)])
def test_chitchat(spark, user, answer, expected):
    assert both(spark, tx.is_chitchat, user, answer) is expected


def test_custom_chitchat(spark):
    f = lambda *custom: value(spark, tx.is_chitchat(F.lit("yolo yolo"), F.lit("x"), custom))
    assert f("yolo") and not f()


def test_tags_and_tokens(spark):
    message = "struct<text:string,thinking:string,tool_calls:array<struct<name:string,arguments:string,result:string,status:string>>,file_changes:array<struct<file_path:string,status:string,additions:bigint,deletions:bigint>>>"
    rows = [
        (1, ("hello there", None, None, None), ("fine", None, None, None)),
        (2, ("see https://a.b", None, [], []), ("```x```", "hm", [("Task", "{}", "ok", "done")], None)),
        (3, (None, None, None, None), None),
    ]
    df = spark.createDataFrame(rows, f"id int, user_message {message}, llm_message {message}")
    got = {r["id"]: (r["tags"], r["n"]) for r in df.select("id", turns.turn_tags().alias("tags"), turns.turn_tokens().alias("n")).collect()}
    assert got[1] == (["Text"], 3 + 1)
    assert got[2][0] == ["Url", "ToolCall", "AgentTool", "SubAgent", "CodeBlock", "Thinking"]
    assert got[3] == (["Text"], 2)


def test_batches_reset(spark):
    rows = [("s", i, t, T0) for i, t in enumerate([50, 60, 200, 10, 99, 1])]
    df = spark.createDataFrame(rows, "session_id string, turn_id long, tokens long, created_at timestamp")
    got = sorted((r["batch"], r["batch_tokens"], r["truncated"]) for r in turns.batch_turns(df, 100).collect())
    assert got == [(0, 110, False), (1, 200, True), (2, 109, False), (3, 1, False)]


def test_eviction_score(spark):
    score = lambda days, access, mark: value(
        spark, lifecycle.eviction_score(F.lit(T0 - dt.timedelta(days=days)), F.lit(access), F.lit(mark), "2025-01-01 00:00:00", (1, 0, 0, 0) if mark is None else None)
    )
    assert [round(score(d, 0, None)) for d in (0, 7, 14)] == [100, 50, 25]
    assert round(score(0, 10, 100), 6) == 100


def test_fusion(spark):
    lists = [spark.createDataFrame([(h, i + 1) for i, h in enumerate(x)], "id string, rank int") for x in (["h1", "h2"], ["h2", "h3"])]
    rows = search.top(search.fuse_ranks(lists, "id"), 10, "id").collect()
    assert [r["id"] for r in rows][0] == "h2" and len(rows) == 3
    assert abs(rows[0]["score"] - (1 / 62 + 1 / 61)) < 1e-12


def test_hybrid_degrades(spark):
    schema = "id string, score double"
    some, none = spark.createDataFrame([("a", 2.0), ("b", 1.0)], schema), spark.createDataFrame([], schema)
    assert {r["source"] for r in search.hybrid(some, none, "id", 5).collect()} == {"keyword"}
    assert {r["source"] for r in search.hybrid(none, some, "id", 5).collect()} == {"semantic"}
    assert {r["source"] for r in search.hybrid(some, some, "id", 5).collect()} == {"hybrid"}
    assert search.hybrid(none, none, "id", 5).count() == 0


def test_keyword_index(spark, tmp_path):
    df = spark.createDataFrame([(1, "the retry window"), (2, "window"), (3, None), (4, ""), (None, "retry")], "id int, text string")
    index = keyword.KeywordIndex(spark, f"{tmp_path}/index", "int")
    assert index.search("retry").count() == 0
    index.index(df, "id", "text")
    ids = lambda query: {r["id"] for r in index.search(query).collect()}
    assert ids(" the ") == set() and ids("retry") == {1} and ids("window") == {1, 2}
    assert index.totals().first()["n"] == 4
    index.index(spark.createDataFrame([(2, "retry retry"), (5, "缓存 retry")], "id int, text string"), "id", "text")
    assert ids("retry") == {1, 2, 5} and ids("window") == {1} and ids("缓") == {5} and index.totals().first()["n"] == 5
    index.unindex(spark.createDataFrame([(1,), (77,), (None,)], "id int"))
    before = {r["id"]: r["score"] for r in index.search("retry window retry").collect()}
    assert set(before) == {2, 5} and index.totals().first()["n"] == 4
    assert {r["id"]: r["score"] for r in index.compact().search("retry window retry").collect()} == before
    fresh = keyword.KeywordIndex(spark, f"{tmp_path}/fresh", "int").index(spark.createDataFrame([(2, "retry retry"), (3, None), (4, ""), (5, "缓存 retry")], "id int, text string"), "id", "text")
    assert {r["id"]: round(r["score"], 9) for r in fresh.search("retry window retry").collect()} == {k: round(v, 9) for k, v in before.items()}
    assert {r["term"]: (r["documents"], r["occurrences"]) for r in index.terms().collect()} == {"retry": (2, 3), "缓": (1, 1), "存": (1, 1)}


def test_a_search_reads_no_text(spark, tmp_path):
    texts = spark.createDataFrame([(1, "the retry window")], "id int, text string")
    texts.write.parquet(f"{tmp_path}/texts")
    index = keyword.KeywordIndex(spark, f"{tmp_path}/index", "int").index(spark.read.parquet(f"{tmp_path}/texts"), "id", "text")
    plan = index.search("retry")._jdf.queryExecution().toString()
    assert f"{tmp_path}/texts" not in plan and "PartitionFilters: [" in plan and "bucket" in plan


def test_okapi_weights(spark):
    docs = ["a a b", "b c", "c", "c d", "c"]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, text string")
    cut = [d.split(" ") for d in docs]
    n, mean = len(cut), sum(map(len, cut)) / len(cut)
    weight = {t: math.log(n - sum(t in d for d in cut) + 0.5) - math.log(sum(t in d for d in cut) + 0.5) for t in "abcd"}
    floor = 0.25 * sum(weight.values()) / 4
    want = [sum((floor if weight[t] < 0 else weight[t]) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in "ac") for d in cut]
    got = {r["id"]: r["score"] for r in search.okapi(df, "id", "text", "a c x").collect()}
    assert all(abs(got[i] - w) < 1e-9 for i, w in enumerate(want)) and weight["c"] < 0


def test_families(spark):
    sessions = spark.createDataFrame([("one-x",), ("one",), ("onex-y",), ("two-a",), ("z",)], "session_id string")
    families = spark.createDataFrame([("A", "one"), ("B", "two")], "family string, prefix string")
    assert {r["family"]: (r["sessions"], r["first"]) for r in increments.by_family(sessions, families, 1).collect()} == {"A": (2, "one"), "B": (1, "two-a"), "custom": (2, "onex-y")}


def brute_batches(tokens, threshold):
    out, total = [0], 0
    for t in tokens:
        out[-1] += t
        total += t
        if total >= threshold:
            out, total = [*out, 0], 0
    return out if out[-1] or not tokens or total else out[:-1]


def test_one_session_over_many_stretches(spark):
    rng = random.Random(5)
    tokens = [rng.choice([0, 1, 5, 30, 120]) for _ in range(900)]
    rows = [(i, "hot", t, at(i)) for i, t in enumerate(tokens)] + [(2000 + i, None, 7, at(0)) for i in range(9)]
    df = spark.createDataFrame(rows, "turn_id long, session_id string, tokens long, created_at timestamp").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = sequences.stretches(df, "session_id", ["created_at", "turn_id"])
        assert cut.filter("session_id = 'hot'").select("__part").distinct().count() > 1
        got = turns.batch_turns(df, 100).collect()
        want = brute_batches(tokens, 100)
        assert [r["batch_tokens"] for r in sorted((r for r in got if r["session_id"]), key=lambda r: r["batch"])] == want[: len([r for r in got if r["session_id"]])]
        assert sum(want) == sum(tokens) and [(r["batch"], r["turns"]) for r in got if not r["session_id"]] == [(0, 9)]
        sums = sequences.running_sum(cut, "session_id", ["created_at", "turn_id"], F.col("tokens"), "s").filter("session_id = 'hot'").orderBy("turn_id").collect()
        assert [r["s"] for r in sums] == [sum(tokens[: i + 1]) for i in range(900)]
        for after in (True, False):
            near = sequences.neighbour(cut, "session_id", ["created_at", "turn_id"], ["turn_id"], after).filter("session_id = 'hot'").orderBy("turn_id").collect()
            step = 1 if after else -1
            assert [r["__next"] and r["__next"]["turn_id"] for r in near] == [i + step if 0 <= i + step < 900 else None for i in range(900)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_turns_and_pairs(spark):
    rows = [
        ("a0", "s", 0, "assistant", "lead", 3, None, 0.5), ("u1", "s", 1, "user", "q", 9, None, None), ("x", "s", 2, "system", "no", 9, None, None), ("a1", "s", 3, "assistant", "one", 4, "stop", 1.0),
        ("a2", "s", 4, "assistant", "", None, None, None), ("a3", "s", 5, "assistant", "two", 5, "length", None), ("o", "s", 6, "other", "as user", 1, None, None), ("u2", "s", 7, "user", "again", 1, None, None),
    ]
    df = spark.createDataFrame(rows, "id string, session_id string, seq long, role string, text string, tokens long, finish string, cost double")
    got = [tuple(r)[1:] for r in turns.pair_turns(df).orderBy("turn").collect()]
    assert got == [(0, None, "lead", 3, None, 0.5, 1), (1, "q", "one\n\ntwo", 9, "length", 1.0, 4), (2, "as user", "", None, None, None, 1), (3, "again", "", None, None, None, 1)]
    assert [tuple(r)[2:] for r in turns.strict_pairs(df).collect()] == [("q", "one")]
    assert sorted(tuple(r)[1:] for r in turns.lenient_pairs(df).collect()) == [(0, "", "lead"), (1, "q", "one"), (5, "", "two"), (7, "again", "")]
    lines = spark.createDataFrame([("s", 1, "1", "Ann", "hi"), ("s", 2, "2", "Ann", "you?"), ("s", 3, "3", "Bob", "fine"), ("s", 4, "4", "Ann", "bye")], "session_id string, seq long, id string, speaker string, text string")
    assert sorted(tuple(r)[1:] for r in turns.speaker_pairs(lines, "Ann").collect()) == [(1, "hi", ""), (2, "you?", "fine"), (4, "bye", "")]


def test_prefix_lookup(spark):
    rows = [
        ("abcd1", "m1", T0, "normal", "session"), ("abcd2", "m2", T0 - dt.timedelta(1), "normal", "project"), ("abcd", "m3", T0, "normal", "project"), ("abcd3", "m4", T0, "deleted", "session"),
        ("abcd1", "p1", T0 - dt.timedelta(9), None, "project"), *((f"wxyz{i}", "m", T0 + dt.timedelta(i), None, "session") for i in range(7)),
    ]
    hooks = spark.createDataFrame(rows, "hook_id string, memory_id string, archived_at timestamp, file_status string, scope string")
    found = [(r["hook_id"], r["memory_id"], r["scope"]) for r in storage.find_by_prefix(hooks, "abcd").collect()]
    assert found == [("abcd", "m3", "project"), ("abcd2", "m2", "project"), ("abcd1", "m1", "session")]
    assert storage.find_by_prefix(hooks, "abc").count() == 0 and storage.find_by_prefix(hooks, "wxyz").count() == 7
    resolve = lambda x: tuple(storage.resolve_prefix(hooks, x).first())
    assert resolve("abcd") == ("found", "abcd", None) and resolve("abcd3") == ("deleted", None, None) and resolve("nothing") == ("unknown", None, None)
    assert resolve("wxyz") == ("ambiguous", None, [f"wxyz{i}" for i in range(5)]) and resolve("abcd2") == ("found", "abcd2", None)


def test_attachments_are_tagged(spark):
    kinds = "array<struct<kind:string>>"
    message = f"struct<text:string,thinking:string,tool_calls:array<struct<name:string>>,file_changes:array<struct<file_path:string>>,attachments:{kinds}>"
    rows = [(("see", None, None, None, [("image",), ("File",)]), ("ok", None, None, None, None)), ((None, None, None, None, None), ("x", None, None, None, [("Voice",), ("Video",)]))]
    df = spark.createDataFrame(rows, f"user_message {message}, llm_message {message}")
    assert [r[0] for r in df.select(turns.turn_tags(attachments=True)).collect()] == [["Image", "FileAttachment"], ["Video", "Voice"]]


def test_relevance_of_all_fields(spark):
    lists = lambda *x: F.array(*map(F.lit, x))
    score = tx.relevance("Rust none", F.lit("rust"), lists("RUST"), lists("a rust fact"), lists("rusty"), lists("x"), F.lit("in rust"))
    assert value(spark, score) == 3 + 2 + 1 + 2 + 1


def test_hook_store(spark, tmp_path):
    schema = "hook_id string, session_id string, scope string, period string, archived_at timestamp"
    df = lambda *rows: spark.createDataFrame([(h, s, c, p, T0) for h, s, c, p in rows], schema)
    store = storage.HookStore(spark, f"{tmp_path}/hooks", df().schema)
    ids = lambda: sorted(r["hook_id"] for r in store.read().collect())
    assert ids() == []
    store.write(df(("a", "s", "session", "daily"), ("b", "s", "session", "daily"), ("c", "t", "session", "daily"), ("d", None, "project", "daily")))
    store.write(df(("e", "s", "session", "daily")))
    assert ids() == ["c", "d", "e"]
    store.append(df(("e", "s", "session", "daily"), ("f", "s", "session", "daily"), ("g", None, "project", "daily")))
    assert ids() == ["c", "d", "e", "f", "g"] and store.read("project").count() == 2 and store.read(period="weekly").count() == 0
    store.delete(df(("", None, "project", "daily"), ("", "zz", "project", "weekly")))
    assert ids() == ["c", "e", "f"]


def test_following(spark, tmp_path):
    schema = "session_id string, seq long, tokens long"
    add = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    kind = spark.createDataFrame([], schema).schema
    add("a", [("s", 1, 60), (None, 2, 999), ("t", 1, 10)])
    follow = lambda tag, **o: totals.follow_events(spark, f"{tmp_path}/in", kind, f"{tmp_path}/out{tag}", totals.checkpoint_for(f"{tmp_path}/c", tag), **o).count()
    due = lambda: sorted(tuple(r)[:3] for r in totals.follow_thresholds(spark, f"{tmp_path}/in", kind, F.col("tokens"), 100, f"{tmp_path}/t", f"{tmp_path}/tc").collect())
    assert follow("v1") == 0 and follow("v2", backfill=True) == 3 and due() == []
    add("b", [("s", 2, 50), ("t", 2, 10)])
    assert follow("v1") == 2 and follow("v2") == 5 and due() == [("s", 110, 2)]
    add("c", [("s", 3, 50), ("t", 3, 200)])
    assert follow("v1") == 4 and due() == [("s", 110, 2), ("t", 220, 3)]  # s began at 0 again
    add("d", [("s", 4, 50)])
    assert due() == [("s", 100, 4), ("s", 110, 2), ("t", 220, 3)] and due() == due()


def test_windows_of_a_stream(spark, tmp_path):
    rows = [(at(0), "a", 1.0), (at(0.4), "a", 2.0), (at(1.2), "a", 4.0), (at(1), "b", None)]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], "ts timestamp, kind string, value double").write.parquet(f"{tmp_path}/in/{i}")
    table = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    want = sorted(map(tuple, totals.windowed_counts(table, "ts", "1 day", ["kind"]).collect()))
    got = sorted(map(tuple, totals.follow_windows(spark, f"{tmp_path}/in", table.schema, "ts", "1 day", ["kind"], max_files=1).collect()))
    assert got == want and len(got) == 3


def test_batch_lookup_fails_alone(spark):
    table = spark.createDataFrame([("a", 1), ("a", 1)], "k string, v int")
    asked = spark.createDataFrame([("a",), ("zz",)], "k string")
    got = {r["k"]: r["success"] for r in storage.batch_lookup(asked, table, "k", ["v"]).collect()}
    assert got == {"a": True, "zz": False}


def test_conflicts(spark):
    facts = [("m", 1, "added", "我喜欢咖啡"), ("m", 2, "added", "我不喜欢咖啡"), ("m", 2, "deprecated", "我喜欢咖啡"), ("m", 3, "added", "tea time now"), ("m", 3, "deprecated", "tea time now"), ("n", 1, "added", "我不喜欢咖啡")]
    df = spark.createDataFrame(facts, "memory_id string, update_seq int, kind string, fact string")
    got = sorted((r["conflict"], r["seq"]) for r in conflicts.detect(df).collect())
    assert got == [("direct", 2), ("reversal", 2), ("self", 3)]
    top = conflicts.summary(conflicts.detect(df)).first()
    assert (top["conflicts"], top["critical"], top["has_critical"]) == (3, 1, True)


REPORT = "memory_id string, seq int, conflict string, new_fact string, existing_fact string, severity string, description string"


def test_merged_reports(spark):
    h = spark.createDataFrame([("m", 1, "self", "likes dark tea", "old", "warning", "short"), ("m", 2, "self", "likes dark tea", "old", "warning", "a long description")], REPORT)
    o = spark.createDataFrame(
        [("m", 1, "self", "likes dark tea", "older", "critical", "a longer one"), ("m", 4, "self", "Likes dark tea", None, "info", "x"), ("m", 1, "direct", "likes dark tea", None, "warning", "d"), ("m", 2, "self", "something else", None, "info", "e")],
        REPORT,
    )
    got = sorted(tuple(r[c] for c in ("conflict", "seq", "new_fact", "existing_fact", "severity", "description")) for r in conflicts.merge_reports(h, o).collect())
    assert got == [
        ("direct", 1, "likes dark tea", None, "warning", "d"), ("self", 1, "likes dark tea", "older", "critical", "a longer one"),
        ("self", 2, "likes dark tea", "old", "warning", "a long description"), ("self", 2, "something else", None, "info", "e"),
    ]
    assert conflicts.merge_reports(h.limit(0), o.limit(0)).count() == 0


def test_embedding_similarity(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "z"), ("a", "c"), ("a", "a b")], "x string, y string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("z", [0.0, 0.0]), ("c", [1.0])], "fact string, vector array<float>")
    got = {r["y"]: round(r["similarity"], 4) for r in conflicts.embedding_similarity(pairs, vectors, "x", "y").collect()}
    assert got == {"b": 0.7071, "z": 0.0, "c": 0.0, "a b": 0.5}


def test_retrieval_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "a", 1), (3, "a", 1)], "question int, item string, rank int")
    answers = spark.createDataFrame([(1, "b"), (1, "c"), (1, "c"), (2, "z")], "question int, item string")
    rows = {(r["question"], r["k"]): r for r in metrics.retrieval_metrics(ranked, answers, "question", "item", [2, 3]).collect()}
    assert [(rows[i, 2]["recall_any"], rows[i, 2]["recall_all"]) for i in (1, 2, 3)] == [(1.0, 0.0), (0.0, 0.0), (0.0, 1.0)]
    assert round(rows[1, 2]["ndcg"], 6) == 0.5 and rows[1, 3]["recall_all"] == 1.0 and rows[3, 3]["ndcg"] == 0.0


def test_first_sessions(spark):
    ranked = spark.createDataFrame([(1, "s", 1), (1, "s", 2), (1, "t", 3), (1, "u", 9), (1, "s", 4)], "question int, session string, rank int")
    assert [(r["session"], r["rank"]) for r in metrics.first_sessions(ranked, "question", "session", 2).orderBy("rank").collect()] == [("s", 1), ("t", 2)]


def test_stratified_sample_has_n_rows(spark):
    df = spark.createDataFrame([(i, "a" if i < 95 else f"s{i}") for i in range(100)], "id int, kind string")
    kinds = [r["kind"] for r in metrics.stratified_sample(df, "kind", "id", 30).collect()]
    assert len(kinds) == 30 and len(set(kinds)) == 6  # filled up
    assert metrics.stratified_sample(df, "kind", "id", 3).count() == 3 and metrics.stratified_sample(df, "kind", "id", 500).count() == 100
    assert metrics.stratified_sample(df.limit(0), "kind", "id", 5).count() == 0


@pytest.mark.parametrize("word, want", [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"),
    ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"),
    ("electrical", "electr"), ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("oscillators", "oscil"), ("is", "is"),
])
def test_stems(word, want):
    assert stem(word) == want


def test_stemmed_f1(spark):
    df = spark.createDataFrame([("The cats were running", "a cat runs"), ("", "x"), (None, "x")], "p string, t string")
    got = [round(r["f1"], 4) for r in metrics.with_stemmed_f1(df, "p", "t").collect()]
    assert got == [round(2 * 2 / 5, 4), 0.0, 0.0]


def test_packed_documents(spark):
    values = [None, True, 5, -7, 300, -(1 << 40), (1 << 64) - 1, 1.5, "é" * 40, "x", b"raw", [1, [2]], list(range(20)), {"a": {"b": None}}, {str(i): i for i in range(20)}]
    assert all(packed.unpack(packed.pack(v)) == v for v in values)
    for raw in (b"", b"\xdb\x00\x00\x00\x09x", b"\xc0\xc0", b"\xc1", b"\xd9\x02\xff\xfe"):
        with pytest.raises(ValueError):
            packed.unpack(raw)
    df = spark.createDataFrame([("a", bytearray(packed.pack({"n": 4, "t": ["x"]}))), ("b", bytearray(b"\xc1")), ("c", None)], "id string, document binary")
    assert {r["id_of"]: (r["n"], r["t"]) for r in packed.from_packed(df, "id", "n int, t array<string>").collect()} == {"a": (4, ["x"]), "b": (None, None), "c": (None, None)}


def test_piece_tokens(spark):
    df = spark.createDataFrame([("hello world",), (None,), ("",)], "t string")
    model = os.path.join(os.environ.get("MNEMOSPARK_TOKENIZERS", "/opt/tokenizers"), "piece_bpe_32k.model")
    if os.path.exists(model):
        sentencepiece = pytest.importorskip("sentencepiece")
        want = len(sentencepiece.SentencePieceProcessor(model_file=model).encode("hello world"))
        assert [r[0] for r in df.select(tx.piece_tokens("t", model)).collect()] == [want, 0, 0]
    assert df.select(tx.piece_tokens("t", "/no/such/model")).collect() == df.select(tx.char_tokens("t")).collect()


def test_answers_in_texts(spark):
    found = lambda t, *a: value(spark, tx.has_answer(F.lit(t), F.array(*map(F.lit, a))))
    assert found("It was the Red House.", "red house") and not found("a bored house", "red house") and found("x", "") and not found("x", None) and not found(None, "x")


def test_category_scores(spark):
    s = lambda c, p, t: value(spark, metrics.category_score(F.lit(c), F.lit(p), F.lit(t)))
    assert s(1, "red, blue", "blue, red") == 1.0
    assert s(3, "the red house", "red house; a hut") == 1.0
    assert s(5, "It is not mentioned.", "x") == 1.0 and s(5, "yes", "x") == 0.0
    assert 0 < s(2, "red house", "red barn") < 1 and s(9, "a", "a") == 0.0


def test_context_parser(spark):
    rows = [
        (1, '[{"user_message":{"text":"q"},"llm_message":{"text":"a"},"x":1},{"user_message":{"text":""}}]'),
        (2, "User: one\nmore\nAssistant: two\nUser: three\nAssistant: four"),
        (3, "a\n---\nb"),
        (4, None),
    ]
    got = sorted((r[0], r[1], r[2], r[3]) for r in parse_context(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect())
    assert got == [(1, 1, "q", "a"), (2, 1, "one\nmore", "two"), (2, 2, "three", "four")]


def test_texts_of_evaluation(spark):
    assert value(spark, tx.dialogue_time(F.lit("2023/05/20 (Sat) 02:21"))) == dt.datetime(2023, 5, 20, 2, 21)
    assert value(spark, tx.dialogue_time(F.lit("1:56 pm on 8 May, 2023"))) == dt.datetime(2023, 5, 8, 13, 56)
    assert value(spark, tx.dialogue_time(F.lit("soon"))) is None
    assert value(spark, tx.fenced_json(F.lit('x ```json\n{"a":1}\n``` y'))) == '{"a":1}'
    score = lambda x: value(spark, tx.parse_score(F.lit(x)))
    assert score("score: 140") == 100.0 and score("Score 3: 85") == 85.0 and score(" 42.5\n") == 42.5 and score("分数：85\nscore: 7") == 85.0
    assert score("about 70% sure\nso 12") == 12.0 and score("70%") == 70.0 and score("-5") == 0.0 and score("none") is None and score("1-2%") is None
    assert value(spark, tx.normalise_answer(F.lit("The  Cat, and a Dog!"))) == "cat dog"


def test_section_edit(spark):
    doc = F.lit("a\n<!-- x -->\nold\n<!-- /x -->\nb")
    assert "new $1" in value(spark, tx.edit_section(doc, "x", "new $1")) and "old" not in value(spark, tx.edit_section(doc, "x", "new"))
    assert value(spark, tx.edit_section(doc, "x", None, "delete")) == "a\nb"
    assert "old\nmore" in value(spark, tx.edit_section(doc, "x", "more", "append"))
    assert value(spark, tx.edit_section(doc, "y", "z")).endswith("<!-- y -->\nz\n<!-- /y -->\n")


def test_pending_tokens(spark):
    messages = spark.createDataFrame([("s", 1, 5), ("s", 2, 7), ("t", 1, 3)], "session_id string, seq long, tokens long")
    archived = spark.createDataFrame([("s", 1)], "session_id string, last_seq long")
    got = {r["session_id"]: r["tokens"] for r in increments.pending_tokens(messages, archived).collect()}
    assert got == {"s": 7, "t": 3}


DELIVERY = "delivery_id long, message_id string, received_at timestamp, extra string, key string"


def at(days):
    return T0 + dt.timedelta(days=days)


def test_one_delivery_stays(spark):
    rows = [
        (1, " A ", at(3), None, None), (2, "a", at(1), "x", "y"), (3, "a ", at(1), None, None), (4, None, at(0), None, None), (5, "  ", at(0), None, None),
        (6, "b", at(0), None, None), (7, "B", at(90), None, None), (8, "c", at(5), None, None), (9, "c", at(6), None, None), (10, "d", None, None, None), (11, "d", at(2), None, None),
    ]
    states = spark.createDataFrame(
        [(1, at(4), ["C", None, "c", "zz", " "]), (2, at(5), ["b"]), (3, at(1), None), (4, None, ["a"])], "state_id long, saved_at timestamp, processed_message_ids array<string>"
    )
    df = spark.createDataFrame(rows, DELIVERY)
    dropped = {r[0] for r in repeated_deliveries(df, states, delay="1 day", slices=3).collect()}
    assert dropped == {1, 3, 7, 8, 9}


def test_deliveries_of_hot_and_empty_tables(spark):
    hot = spark.range(300).selectExpr("id AS delivery_id", "'m' AS message_id", "timestamp_seconds(1700000000 + id % 50) AS received_at")
    assert [r[0] for r in keep_one_delivery(hot, slices=2).collect()] == [0]
    empty = spark.createDataFrame([], DELIVERY)
    assert keep_one_delivery(empty).count() == 0


def kept_by(spark, rows, **options):
    return sorted(r[0] for r in keep_one_delivery(spark.createDataFrame(rows, DELIVERY), **options).collect())


def test_the_store_decides(spark, monkeypatch):
    rows = [(n, f"m{n % 40}", at(n / 8), None, None) for n in range(160)]  # each comes again after 5, 10 and 15 days
    assert kept_by(spark, rows, delay="7 days", slices=4) == list(range(40))
    monkeypatch.setattr(deliveries, "first_arrivals", lambda stream, key, time, delay: stream.withWatermark(time, delay))
    assert len(kept_by(spark, rows, delay="7 days", slices=4)) > 40  # the lookup knows only what the store may have forgotten


def test_forgotten_identifiers_are_looked_up(spark, monkeypatch):
    rows = [(n, f"m{n % 40}", at(n), None, None) for n in range(160)]  # each comes again after 40 days
    assert kept_by(spark, rows, delay="2 days", slices=4) == list(range(40))
    monkeypatch.setattr(deliveries.Follower, "_write", lambda self, batch, number: batch.withColumn("bucket", F.lit(0)).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.out}/rows/number={number}"))
    assert len(kept_by(spark, rows, delay="2 days", slices=4)) > 40


@pytest.mark.parametrize("rocksdb", [False, True])
def test_calls_on_one_checkpoint_keep_one_copy(spark, tmp_path, rocksdb):
    both = {"out": f"{tmp_path}/out", "checkpoint": f"{tmp_path}/checkpoint", "delay": "3 days", "slices": 2, "rocksdb": rocksdb}
    first = [(n, f"m{n}", at(n), None, None) for n in range(20)]
    again = [(100 + n, f" M{n} ", at(21 + n / 10), None, None) for n in range(30)]
    late = [(200 + n, f"m{n}", at(n % 3), None, None) for n in range(40)]  # before the watermark, half of them known
    assert kept_by(spark, first, **both) == list(range(20))
    assert kept_by(spark, again, **both) == [*range(20), *range(120, 130)]
    assert kept_by(spark, late, **both) == [*range(20), *range(120, 130), *range(230, 240)]
    assert kept_by(spark, first, **both) == [*range(20), *range(120, 130), *range(230, 240)]
    with pytest.raises(ValueError):
        keep_one_delivery(spark.createDataFrame(first, DELIVERY), out="x")


def test_a_batch_that_is_run_again_overwrites_its_output(spark, tmp_path):
    rows = spark.createDataFrame([("a", at(1), 1), ("b", at(2), 2)], "key string, received_at timestamp, delivery_id long")
    follower = deliveries.Follower(spark, f"{tmp_path}/inbox", f"{tmp_path}/out", f"{tmp_path}/checkpoint", rows.schema)
    for _ in range(2):
        follower._write(rows.withColumn("seen_at", F.col("received_at")), 0)
    assert deliveries.written(spark, f"{tmp_path}/out", rows.schema).count() == 2


def test_payloads(spark):
    from mnemospark.sources.context import parse_payloads

    rows = [
        ("a", T0, '{"content":[{"type":"reasoning","text":"r1"},{"type":"text","text":"x"},{"type":"text","text":"y"},{"type":"tool","name":"grep"}],"finish":"stop","cost":0.5}'),
        ("b", T0, '{"text":"plain"}'), ("c", T0, '{"text":"cut'), ("d", T0, None),
        ("e", T0, '{"content":[{"type":"text","text":"x"},{"type":"step-finish","tokens":{"input":1,"output":2,"reasoning":3},"reason":"length","cost":2.0}],"finish":"stop","cost":0.5}'),
    ]
    got = {r["id"]: tuple(r)[2:] for r in parse_payloads(spark.createDataFrame(rows, "id string, received_at timestamp, data string")).collect()}
    assert got["a"] == ("x\ny", "r1", 1, None, "stop", 0.5)
    assert got["b"][0] == "plain" and got["b"][2] == 0
    assert got["c"][2:] == got["d"][2:] == (0, None, None, None)
    assert got["e"] == ("x", "", 0, 6, "length", 2.0)
