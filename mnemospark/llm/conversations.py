"""Rebuilding conversations from message rows."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_WORD = r"[\p{L}\p{N}]"


def message_nodes(messages: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per message id: (id, session_id, role, seq, valid, words, parent[, text]).

    Of rows with one id the last received counts; a row without id stands for
    itself. role is the type in lower case without outer blanks; valid: data is
    one JSON value; words: its text, or that of a part of type text, holds a
    letter or digit; text joins those by line feeds. Null, blank and damaged data
    are not valid. Rows without session are kept out, but still replace earlier
    rows of their id. Columns that are not named above are ignored.
    """
    # in brackets, trailing garbage is no valid JSON either
    v = F.expr("try_parse_json(concat('[', data, ']'))")
    rows = messages.select("id", "session_id", "type", "seq", "received_at", "data").withColumn("v", v)
    parts = F.expr("try_variant_get(v, '$[0].content', 'array<struct<type:string,text:string>>')")
    texts = F.array_compact(
        F.concat(
            F.array(F.expr("try_variant_get(v, '$[0].text', 'string')")),
            F.coalesce(
                F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]),
                F.array().cast("array<string>"),
            ),
        )
    )
    rows = rows.select(
        F.coalesce("id", F.concat(F.lit("row:"), F.xxhash64("session_id", "type", "seq", "received_at", "data").cast("string"))).alias("id"),
        F.struct(
            F.when(F.trim("session_id") != "", F.col("session_id")).alias("session_id"),
            F.lower(F.regexp_replace("type", r"^\s+|\s+$", "")).alias("role"),
            "seq",
            F.coalesce(F.expr("v is not null and variant_get(v, '$[0]') is not null and variant_get(v, '$[1]') is null"), F.lit(False)).alias("valid"),
            F.coalesce(F.exists(texts, lambda t: t.rlike(_WORD)), F.lit(False)).alias("words"),
            F.expr("try_variant_get(v, '$[0].parent', 'string')").alias("parent"),
            *([F.array_join(texts, "\n").alias("text")] if with_text else []),
        ).alias("m"),
        F.struct("received_at", F.xxhash64("data")).alias("at"),
    )
    latest = rows.groupBy("id").agg(F.max_by("m", "at").alias("m"))
    return latest.select("id", "m.*").filter("session_id is not null")


def resolve_parents(nodes: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(session_id, id, parent, parent_role, root, hops, status) of each node that names a parent.

    Pointer jumping: each round every open pointer is replaced by the pointer
    of the row it points at, so chains of n take log2(n) rounds. status is
    `ok`, `orphan` (the chain ends at an id that is not there) or `cycle` (still
    open when chains of any length the table could hold must have ended; root is
    null). Nodes are known by (session_id, id); role may be null. Each round is
    written to the shared folder, and only the open pointers go on, so a hot
    parent costs one row per child and round.
    """
    look = nodes.select("session_id", F.col("id").alias("ptr"), F.col("role").alias("parent_role"), F.col("parent").alias("next"))
    edges = nodes.filter("parent is not null").select("session_id", "id", "parent", F.col("parent").alias("ptr"))
    first = edges.join(look, ["session_id", "ptr"], "left")
    state = materialize(
        first.select(
            "session_id",
            "id",
            "parent",
            "parent_role",
            F.when(F.col("next").isNotNull(), F.col("next")).otherwise(F.col("ptr")).alias("ptr"),
            F.when(F.col("next").isNotNull(), 2).otherwise(1).cast("long").alias("hops"),
            F.when(F.col("parent_role").isNull() & F.col("next").isNull(), F.lit("absent?"))
            .when(F.col("next").isNotNull(), F.lit("open"))
            .otherwise(F.lit("ok"))
            .alias("status"),
        ),
        "parents",
    )
    # a parent without role and without parent may be there all the same
    if not state.filter("status = 'absent?'").isEmpty():
        there = nodes.filter("role is null and parent is null").select("session_id", F.col("id").alias("ptr"), F.lit(True).alias("there"))
        state = materialize(
            state.join(there, ["session_id", "ptr"], "left")
            .withColumn("status", F.when(F.col("status") != "absent?", F.col("status")).when(F.col("there"), "ok").otherwise("orphan"))
            .drop("there"),
            "parents",
        )
    done = [state.filter("status <> 'open'")]
    opened = state.filter("status = 'open'")
    count = opened.count()
    rounds = min(max_rounds, max(1, math.ceil(math.log2(count + 2)) + 1))
    known = done[0]
    for _ in range(rounds if count else 0):
        at = known.select("session_id", F.col("id").alias("ptr"), F.col("ptr").alias("p2"), F.col("hops").alias("h2"), F.col("status").alias("s2")).unionByName(
            opened.select("session_id", F.col("id").alias("ptr"), F.col("ptr").alias("p2"), F.col("hops").alias("h2"), F.lit("open").alias("s2"))
        )
        roots = nodes.filter("parent is null").select("session_id", F.col("id").alias("ptr"), F.lit(True).alias("is_root"))
        jumped = materialize(
            opened.join(at, ["session_id", "ptr"], "left")
            .join(roots, ["session_id", "ptr"], "left")
            .select(
                "session_id",
                "id",
                "parent",
                "parent_role",
                F.coalesce("p2", "ptr").alias("ptr"),
                (F.col("hops") + F.coalesce("h2", F.lit(0))).alias("hops"),
                F.when(F.col("s2").isNotNull(), F.col("s2")).when(F.col("is_root"), "ok").otherwise("orphan").alias("status"),
            ),
            "parents",
        )
        done.append(jumped.filter("status <> 'open'"))
        known = known.unionByName(done[-1])
        opened = jumped.filter("status = 'open'")
        if opened.isEmpty():
            break
    out = known
    if count:
        out = out.unionByName(opened.withColumn("status", F.lit("cycle")))
    return out.select(
        "session_id", "id", "parent", "parent_role", F.when(F.col("status") != "cycle", F.col("ptr")).alias("root"), "hops", "status"
    )


def root_to_leaf_paths(nodes: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(session_id, leaf, position, id): the messages on the way from a root (position 0) to each leaf, a message that none names as its parent.

    Ancestors are found by doubling: round k adds to each leaf those 2^k to
    2^(k+1) - 1 steps up, by pointers of length 2^k, so paths of n take log2(n)
    rounds. A branched conversation has a path for each leaf; one row of a path
    is one row here, however long it is. Leaves whose chain ends at an absent
    message, and messages within or below cycles, have no path.
    """
    named = nodes.select("session_id", "id", "parent")
    resolved = materialize(resolve_parents(nodes, max_rounds).select("session_id", "id", "hops", "status"), "resolved")
    parents = named.filter("parent is not null").select("session_id", F.col("parent").alias("id")).distinct()
    leaves = named.join(parents, ["session_id", "id"], "left_anti").join(resolved, ["session_id", "id"], "left").filter("coalesce(status, 'ok') = 'ok'")
    known = materialize(leaves.select("session_id", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up"), F.coalesce("hops", F.lit(0)).alias("depth")), "paths")
    longest = known.agg(F.max("depth")).first()[0] or 0
    steps = materialize(named.filter("parent is not null").join(resolved.filter("status = 'ok'"), ["session_id", "id"]).select("session_id", "id", F.col("parent").alias("to")), "steps")
    length = 1
    while length <= longest:
        more = known.join(steps, ["session_id", "id"]).select("session_id", "leaf", F.col("to").alias("id"), (F.col("up") + length).alias("up"), "depth")
        known = materialize(known.unionByName(more), "paths")
        next_ = steps.select("session_id", F.col("id").alias("to"), F.col("to").alias("further"))
        length *= 2
        if length <= longest:
            steps = materialize(steps.join(next_, ["session_id", "to"]).select("session_id", "id", F.col("further").alias("to")), "steps")
    return known.select("session_id", "leaf", (F.col("depth") - F.col("up")).alias("position"), "id")


def _in_order(nodes: DataFrame, *columns: str) -> DataFrame:
    """Sorted by session and seq over range partitions, so that one session may fill many of them."""
    rows = nodes.select("session_id", "seq", *columns)
    return rows.repartitionByRange("session_id", "seq").sortWithinPartitions("session_id", "seq")


_STRETCH = "session_id string, part long, messages long, broken boolean, speakers long, first_role string, last_role string, unanswered boolean"


def _stretches(batches):
    """What each stretch of a session within one range partition amounts to."""
    part = TaskContext.get().partitionId()
    out: list[tuple] = []
    session, state, seq_before = None, None, None
    for batch in batches:
        for name, seq, role, valid, words in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if name != session or state is None:
                if state:
                    out.append((session, part, *state))
                session, state, seq_before = name, [0, False, 0, None, None, False], None
            if role is None:
                continue
            if not valid or seq is None or (state[0] and seq == seq_before):
                state[1] = True
            state[0] += 1
            seq_before = seq
            if words:
                if state[2] and state[4] == "user" and role == "user":
                    state[5] = True
                state[2] += 1
                state[3] = state[3] or role
                state[4] = role
        if len(out) > 5000:
            yield _rows(out)
            out = []
    if state:
        out.append((session, part, *state))
    if out:
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
    names = [c.split()[0] for c in _STRETCH.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def session_defects(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(session_id, defect) of every session: null, or the first of broken, empty, missing_reply that applies.

    `nodes` as from message_nodes, `parents` as from resolve_parents over the
    user and assistant nodes. broken: invalid data, no seq, a seq held by two
    ids, a parent that is no user message of the session, or an assistant speaks
    first; empty: no message with words; missing_reply: a user message with
    words is not followed directly by an assistant message with words.
    """
    speaks = F.col("role").isin("user", "assistant")
    ordered = _in_order(
        nodes.select("session_id", "seq", F.when(speaks, F.col("role")).alias("role"), "valid", "words"), "role", "valid", "words"
    )
    parts = ordered.mapInArrow(_stretches, _STRETCH)
    # stretches of one session meet at the partitions' borders; there are at most as many as partitions
    spoken = F.col("speakers") > 0
    w = Window.partitionBy("session_id", "spoken").orderBy("part")
    parts = parts.withColumn("spoken", spoken)
    parts = parts.withColumn("next_role", F.lead("first_role").over(w)).withColumn("n", F.row_number().over(w))
    unanswered = F.col("unanswered") | (F.col("spoken") & (F.col("last_role") == "user") & ~F.coalesce(F.col("next_role") == "assistant", F.lit(False)))
    of_session = parts.groupBy("session_id").agg(
        F.max("broken").alias("broken"),
        F.sum("speakers").alias("speakers"),
        F.max(F.when(F.col("spoken") & (F.col("n") == 1), F.col("first_role"))).alias("first_role"),
        F.max(unanswered).alias("unanswered"),
    )
    strays = parents.filter("status = 'orphan' or parent_role is null or parent_role <> 'user'").select("session_id").distinct().withColumn("stray", F.lit(True))
    return of_session.join(strays, "session_id", "left").select(
        "session_id",
        F.when(F.col("broken") | F.coalesce("stray", F.lit(False)), "broken")
        .when(F.col("speakers") == 0, "empty")
        .when(F.col("first_role") == "assistant", "broken")
        .when(F.col("unanswered"), "missing_reply")
        .alias("defect"),
    )


def defective_sessions(messages: DataFrame) -> DataFrame:
    """(session_id, defect): the sessions that make no conversation."""
    nodes = materialize(message_nodes(messages), "nodes")
    parents = resolve_parents(nodes.filter(F.col("role").isin("user", "assistant")))
    return session_defects(nodes, parents).filter("defect is not null")


_TURN = "session_id string, seq long, role string, text string, root string, part long, local_turn long"


def _turns(batches):
    """Numbers the user messages within each stretch; 0 goes on with the turn of the stretch before."""
    part = TaskContext.get().partitionId()
    session, turn = None, 0
    for batch in batches:
        numbers = []
        for name, role in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if name != session:
                session, turn = name, 0
            turn += role == "user"
            numbers.append(turn)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([part] * n, pa.int64()), pa.array(numbers, pa.int64())], names=[c.split()[0] for c in _TURN.split(", ")]
        )


def rebuild_conversations(messages: DataFrame) -> DataFrame:
    """(session_id, turn, user_seq, user_message, llm_message, root_id) of every sound session, ordered by turn within it.

    Sound sessions are those session_defects finds nothing in and whose parents
    form no cycle. A turn is a user
    message with words and the assistant messages with words up to the next
    one, joined by line feeds in order of seq; root_id is the user message the
    first answer's parents lead to, the user message itself where it names none.
    Only whole turns are gathered into one row, however long the session.
    """
    nodes = materialize(message_nodes(messages, with_text=True), "nodes")
    speakers = nodes.filter(F.col("role").isin("user", "assistant"))
    parents = resolve_parents(speakers)
    sound = session_defects(nodes.drop("text"), parents).filter("defect is null").select("session_id")
    sound = sound.join(parents.filter("status = 'cycle'").select("session_id").distinct(), "session_id", "left_anti")
    said = speakers.filter("words").join(sound, "session_id", "left_semi")
    said = said.join(parents.select("session_id", "id", "root"), ["session_id", "id"], "left").withColumn("root", F.when(F.col("root").isNotNull(), F.col("root")).when((F.col("role") == "user") & F.col("parent").isNull(), F.col("id")))
    ordered = materialize(_in_order(said, "role", "text", "root").mapInArrow(_turns, _TURN), "turns")
    w = Window.partitionBy("session_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        ordered.groupBy("session_id", "part")
        .agg(F.max("local_turn").alias("n"))
        .select("session_id", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    )
    turns = ordered.join(before, ["session_id", "part"]).withColumn("turn", F.col("before") + F.col("local_turn"))
    is_user = F.col("role") == "user"
    return turns.groupBy("session_id", "turn").agg(
        F.max(F.when(is_user, F.col("seq"))).alias("user_seq"),
        F.max(F.when(is_user, F.col("text"))).alias("user_message"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when(~is_user, F.struct("seq", "text")))), lambda x: x["text"]), "\n"
        ).alias("llm_message"),
        F.coalesce(F.min_by("root", F.when(~is_user, F.col("seq"))), F.max(F.when(is_user, F.col("root")))).alias("root_id"),
    )
