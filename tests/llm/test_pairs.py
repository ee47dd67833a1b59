import datetime as dt

import pytest

from mnemospark.llm import pairs as P

Q = "Why did the cache drop the index?"


@pytest.mark.parametrize("prompt, answer, tools, stop, expected", [
    (Q, None, 0, None, "empty"), (Q, None, 1, None, None), (Q, "<nil>", 0, "stop", "empty"), (Q, "​", 0, None, "empty"), (Q, "```\n```", 0, None, "empty"), (Q, "42", 0, None, None), (Q, "Not yet.", 0, None, None),
    (Q, Q, 0, None, "copy"), (Q, f"You asked: {Q}", 0, None, "copy"), (Q, f"> {Q}\n\nThe lease had expired before the run.", 0, None, None), (Q, f"{Q}\n{Q}", 0, None, "copy"),
    (Q, "I'm sorry, but I can't help with the cache. No exceptions here.", 0, None, "refusal"), (Q, "I can't reproduce it on main, but here is what I found. The lease expired.", 0, None, None),
    (Q, "Sorry for the delay, the fix is below. The lease expired.", 0, None, None), ("为什么？怎么办呢", "抱歉，这个问题我不能回答。", 0, None, "refusal"), (Q, "Tut mir leid, dazu darf ich nichts sagen.", 0, None, "refusal"),
    (Q, "The lease expired before the", 0, "stop", "truncated"), (Q, "The lease expired. For example:", 0, None, "truncated"), (Q, "See this:\n```\nlet a = 1", 0, None, "truncated"), (Q, "There are three steps.\n1. Stop it.\n2. Start it.", 0, None, "truncated"),
    (Q, "There are two steps.\n1. Stop it.\n2. Start it.", 0, "length", None), (Q, "It is done.\n\n- drop the old index\n- start the cache", 0, "length", None), (Q, "Done, pushed to main", 0, "stop", None), (Q, "The lease expired. See https://docs.a.example/b", 0, None, None),
    (Q, "Der Dienst prüft die alten Einträge und leert das ganze Verzeichnis.", 0, None, "language"), (Q, "缓存层清理了空白回复，结果与基线一致。", 0, None, "language"),
    ("Answer in Chinese: the cache dropped the index", "缓存层清理了空白回复，结果与基线一致。", 0, None, None), ("为什么缓存层清理了空白回复？", "```\nlet a = 1;\n```", 0, None, None),
])
def test_defect(prompt, answer, tools, stop, expected):
    assert P.defect(prompt, answer, tools, stop, False, False) == expected


def test_defective_pairs(spark):
    message = "struct<text:string,thinking:string,tool_calls:array<struct<name:string,arguments:string,result:string,status:string>>,file_changes:array<struct<file_path:string,status:string,additions:bigint,deletions:bigint>>>"
    m = lambda text: (text, None, None, None)
    t = dt.datetime(2025, 1, 1)
    whole = "The registry evicted the lease of the worker and then it restarted the queue."
    rows = [
        (1, m(Q), m("fine, it works."), None, t, "x"), (1, m(Q), m(None), None, t + dt.timedelta(1), "x"), (2, m(None), m(None), None, t, "x"), (3, m("  "), m(""), None, t, "x"), (4, None, None, None, t, "x"),
        (5, m(Q), None, None, t, "x"), (6, m(Q), m(whole), None, t, "x"), (7, m(Q), m(whole[:50]), None, t, "x"), (None, m(Q), m(None), None, t, "x"), (8, m(Q), m("word. " * 40000), None, t, "x"),
    ]
    df = spark.createDataFrame(rows, f"turn_id long, user_message {message}, llm_message {message}, stop_reason string, received_at timestamp, word string")
    assert {r[0]: r[1] for r in P.defective_pairs(df).collect()} == {1: "empty", 5: "empty", 7: "truncated"}
    assert P.defective_pairs(df.limit(0)).count() == 0
    texts = spark.createDataFrame([(x,) for x in ("abc", "abcd", "abd", "b", "b", None, "")], "text string")
    assert sorted(r["size"] for r in P.shortened_texts(texts).collect()) == [3]


def test_limit_lengths(spark):
    rows = [("x" * 100,)] * 40 + [("y" * n,) for n in range(80, 120)] + [("z" * 99 + ".",)] * 40
    assert [r["size"] for r in P.limit_lengths(spark.createDataFrame(rows, "text string")).collect()] == [100]
    assert P.limit_lengths(spark.createDataFrame([("y" * n,) for n in range(200)] * 5, "text string")).count() == 0


ITEMS = "The lockfile was stale.\n\n- drop the old index\n- stop the idle worker\n- start"


@pytest.mark.parametrize("answer, stop, expected", [
    (f"{ITEMS} the cold cache", "stop", None), (f"{ITEMS} the cold cache", "length", None), (f"{ITEMS} lib/a/b.py", "length", None),
    (f"{ITEMS} the cold", "length", "truncated"), (f"{ITEMS} the", "stop", "truncated"), (f"{ITEMS} the new lockf", "stop", None), (f"{ITEMS} the new lockfiles", "stop", None),
    ("Do this:\n\n- Drop the old index.\n- Stop it.\n- Start the new cach", "stop", "truncated"),
])
def test_last_item(answer, stop, expected):
    assert P.defect(Q, answer, 0, stop, False, False) == expected


def test_words_cut_by_their_neighbours(spark):
    lines = ["start the cold cache now"] * 120 + ["a cab or a cabin in it"] * 3 + ["start the cold cac"] + ["the cab", "it is in", "x"]
    words = {r["word"] for r in P.cut_words(spark.createDataFrame([(x,) for x in lines], "text string")).collect()}
    assert words == {"cac"}
    assert P.cut_words(spark.createDataFrame([], "text string")).count() == 0
    t = dt.datetime(2025, 1, 1)
    turns = [(n, (Q,), (x, None), "stop", t) for n, x in enumerate([f"{ITEMS} the old lockf", f"{ITEMS} the old lockfile", *[f"Drop the lockfile of run {k} first." for k in range(9)]])]
    df = spark.createDataFrame(turns, "turn_id long, user_message struct<text:string>, llm_message struct<text:string,tool_calls:array<string>>, stop_reason string, received_at timestamp")
    assert {r[0]: r[1] for r in P.defective_pairs(df).collect()} == {0: "truncated"}  # by its neighbours alone: see test_last_item


@pytest.mark.parametrize("answer", ["キャッシュが索引を落としました。ひらがなとカタカナです。", "Кэш удалил индекс ночью и восстановил запись.", "캐시가 색인을 삭제했습니다. 다시 만들었습니다."])
def test_scripts_of_their_own(answer):
    assert P.defect(Q, answer, 0, None, False, False) == "language" and P.defect(answer, answer + " " + answer[::-1], 0, None, False, False) != "language"
    assert P.defect("缓存层为什么清理了空白回复？", answer, 0, None, False, False) == "language"


def test_no_length_switches():
    assert P.defect(Q, "I'm sorry, but I can't help with the cache. " + "I hope you understand. " * 40, 0, None, False, False) == "refusal"
    assert P.defect(Q, "There are fifteen points here, and " + "so on and on " * 40 + "in 15 steps.\n1. Stop it.\n2. Start it.", 0, None, False, False) == "truncated"


def test_one_verdict_in_tables_of_any_size(spark):
    t = dt.datetime(2025, 1, 1)
    turn = (0, (Q,), (f"{ITEMS} the cold cache", None), "stop", t)
    cut = (1, (Q,), (f"{ITEMS} the cold", None), "length", t)
    more = [(n, (Q,), (f"It is done.\n\n- start the cold cache\n- stop the idle cold\n- drop the index {n}.", None), "stop", t) for n in range(2, 40)]
    for rows in ([turn, cut], [turn, cut, *more[:1]], [turn, cut, *more]):
        df = spark.createDataFrame(rows, "turn_id long, user_message struct<text:string>, llm_message struct<text:string,tool_calls:array<string>>, stop_reason string, received_at timestamp")
        assert {r[0]: r[1] for r in P.defective_pairs(df).collect() if r[0] < 2} == {1: "truncated"}


@pytest.mark.parametrize("answer", ["The registry evicted the lease of the worker.", f"{ITEMS} the cold cache"])
def test_continued_answer_at_a_limit(answer):
    assert P.defect(Q, answer, 0, "MAX_TOKENS ", True, False) == "truncated"
    assert P.defect(Q, answer, 0, "stop", True, False) is None and P.defect(Q, answer, 0, "length", False, False) is None
