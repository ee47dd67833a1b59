import datetime as dt
import json

from mnemospark.llm import conversations as C

T0 = dt.datetime(2025, 1, 1)
SCHEMA = "id string, session_id string, type string, seq long, data string, received_at timestamp, text string, role string"


def rows(*items):
    out = []
    for i, (id_, session, kind, seq, data, *late) in enumerate(items):
        out.append((id_, session, kind, seq, data if data is None or isinstance(data, str) else json.dumps(data), T0 + dt.timedelta(minutes=late[0] if late else 0), "clash", None))
    return out


def user(text, **more):
    return {"text": text, **more}


def answer(text, **more):
    return {"content": [{"type": "reasoning", "text": "hm"}, {"type": "text", "text": text}, {"type": "tool", "name": "x"}], **more}


def found(spark, items):
    return {r["session_id"]: r["defect"] for r in C.defective_sessions(spark.createDataFrame(rows(*items), SCHEMA)).collect()}


def test_defects(spark):
    assert found(spark, [
        ("g1", "good", " User ", 1, user("q")), ("g2", "good", "ASSISTANT", 5, answer("a", parent="g1")), ("g3", "good", "system", 5, "{bad"),
        ("b1", "json", "user", 1, user("q")), ("b2", "json", "assistant", 2, '{"content": [} x'),
        ("t1", "tail", "user", 1, json.dumps(user("q")) + "\nreset"), ("t2", "tail", "assistant", 2, answer("a")),
        ("n1", "noseq", "user", None, user("q")), ("n2", "noseq", "assistant", 2, answer("a")),
        ("d1", "same", "user", 1, user("q")), ("d2", "same", "assistant", 1, answer("a")),
        ("o1", "orphan", "user", 1, user("q")), ("o2", "orphan", "assistant", 2, answer("a", parent="gone")),
        ("p1", "other", "user", 1, user("q")), ("p2", "other", "assistant", 2, answer("a", parent="g1")),
        ("e1", "empty", "user", 1, user("...")), ("e2", "empty", "assistant", 2, answer(" ")),
        ("s1", "none", "system", 1, user("only system")),
        ("a1", "first", "assistant", 1, answer("a")), ("a2", "first", "user", 2, user("q")), ("a3", "first", "assistant", 3, answer("a")),
        ("m1", "missing", "user", 1, user("q")), ("m2", "missing", "user", 2, user("q")), ("m3", "missing", "assistant", 3, answer("a")),
        ("l1", "last", "user", 1, user("q")), ("l2", "last", "assistant", 2, answer("a")), ("l3", "last", "user", 3, user("q")),
        ("x1", None, "user", 1, user("q")), ("z1", "null", "user", 1, None),
    ]) == {
        "json": "broken", "tail": "broken", "noseq": "broken", "same": "broken", "orphan": "broken", "other": "broken", "empty": "empty", "none": "empty",
        "first": "broken", "missing": "missing_reply", "last": "missing_reply", "null": "broken",
    }


def test_last_received_row_counts(spark):
    items = [
        ("u", "s", "user", 1, "{broken", 0), ("u", "s", "user", 1, user("q"), 5), ("a", "s", "assistant", 2, answer("a"), 1), ("a", "s", "assistant", 2, answer("a"), 1),
        ("v", "t", "user", 1, user("q"), 0), ("v", None, "user", 1, user("q"), 9),
    ]
    assert found(spark, items) == {}
    assert found(spark, [("u", "s", "user", 1, user("q"))][:0]) == {}


def test_conversations_are_rebuilt(spark):
    items = [("u2", "s", "user", 20, user("second")), ("u1", "s", "user", 3, user("first")), ("a1", "s", "assistant", 7, answer("one", parent="u1")), ("a2", "s", "assistant", 9, answer("two", parent="a0")),
             ("a3", "s", "assistant", 21, answer("three")), ("q", "t", "user", 1, user("no reply"))]
    items[3] = ("a2", "s", "assistant", 9, answer("two", parent="u1"))
    got = [tuple(r) for r in C.rebuild_conversations(spark.createDataFrame(rows(*items), SCHEMA)).orderBy("turn").collect()]
    assert got == [("s", 1, 3, "first", "one\ntwo", "u1"), ("s", 2, 20, "second", "three", "u2")]


def test_one_session_over_many_partitions(spark):
    items = []
    for i in range(600):
        items += [(f"u{i}", "hot", "user", 2 * i, user(f"q{i}")), (f"a{i}", "hot", "assistant", 2 * i + 1, answer(f"a{i}", parent=f"u{i}"))]
    df = spark.createDataFrame(rows(*items), SCHEMA).repartition(7)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert C.defective_sessions(df).count() == 0
        turns = C.rebuild_conversations(df).orderBy("turn").collect()
        assert [(r["turn"], r["user_message"], r["llm_message"]) for r in turns] == [(i + 1, f"q{i}", f"a{i}") for i in range(600)]
        cut = df.filter("id <> 'a299'")
        assert [r["defect"] for r in C.defective_sessions(cut).collect()] == ["missing_reply"]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_pointer_jumping(spark):
    nodes = [("s", "r", "user", None)] + [("s", f"c{i}", "user", f"c{i - 1}" if i else "r") for i in range(40)]
    nodes += [("s", "x", "user", "y"), ("s", "y", "user", "x"), ("s", "w", "user", "x"), ("s", "me", "user", "me"), ("s", "o", "user", "nowhere"), ("s", "p", "user", "o"), ("t", "c", "user", "r"), ("s", "k", None, None), ("s", "kk", "user", "k")]
    df = spark.createDataFrame(nodes, "session_id string, id string, role string, parent string")
    got = {(r["session_id"], r["id"]): (r["root"], r["hops"], r["status"]) for r in C.resolve_parents(df).collect()}
    assert all(got[("s", f"c{i}")] == ("r", i + 1, "ok") for i in range(40))
    assert {got[("s", n)][2] for n in ("x", "y", "w", "me")} == {"cycle"} and got[("s", "x")][0] is None
    assert got[("s", "o")][2] == got[("s", "p")][2] == got[("t", "c")][2] == "orphan"
    assert got[("s", "kk")][::2] == ("k", "ok")


def test_root_to_leaf_paths(spark):
    nodes = [("s", "r", "user", None), *(("s", f"c{i}", "user", f"c{i - 1}" if i else "r") for i in range(9)), ("s", "b", "assistant", "c3"), ("s", "x", "user", "y"), ("s", "y", "user", "x"), ("s", "z", "user", "x"), ("s", "o", "user", "gone"), ("t", "only", "user", None)]
    df = spark.createDataFrame(nodes, "session_id string, id string, role string, parent string")
    got: dict = {}
    for r in C.root_to_leaf_paths(df).collect():
        got.setdefault((r["session_id"], r["leaf"]), {})[r["position"]] = r["id"]
    want = {("s", "c8"): ["r", *(f"c{i}" for i in range(9))], ("s", "b"): ["r", "c0", "c1", "c2", "c3", "b"], ("t", "only"): ["only"]}
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == want
    assert C.root_to_leaf_paths(df.limit(0)).count() == 0


def test_cycles_make_no_conversation(spark):
    items = [("u1", "s", "user", 1, user("q", parent="u2")), ("u2", "s", "user", 2, user("..", parent="u1")), ("a", "s", "assistant", 3, answer("a", parent="u1"))]
    df = spark.createDataFrame(rows(*items), SCHEMA)
    assert C.defective_sessions(df).count() == 0 and C.rebuild_conversations(df).count() == 0


def test_the_first_answer_names_the_root(spark):
    items = [("u1", "s", "user", 1, user("one")), ("a1", "s", "assistant", 2, answer("a", parent="u1")), ("u2", "s", "user", 3, user("two")), ("a2", "s", "assistant", 4, answer("late", parent="u1")), ("a3", "s", "assistant", 5, answer("b", parent="u2")),
             ("u3", "s", "user", 6, user("three")), ("a4", "s", "assistant", 7, answer("c")), ("a5", "s", "assistant", 8, answer("d", parent="u1"))]
    got = {r["turn"]: r["root_id"] for r in C.rebuild_conversations(spark.createDataFrame(rows(*items), SCHEMA)).collect()}
    assert got == {1: "u1", 2: "u1", 3: "u3"}
