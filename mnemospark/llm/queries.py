"""Queries of the operators for training data, each over whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load, materialize
from . import conversations, knn, level, neardup, packing, pairs, split, tokens


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.defective_sessions(load(spark, folder, "session_messages"))


def p1_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.rebuild_conversations(load(spark, folder, "session_messages"))


def p1_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The root-to-leaf paths of the user and assistant messages of all sessions."""
    nodes = materialize(conversations.message_nodes(load(spark, folder, "session_messages")), "nodes")
    return conversations.root_to_leaf_paths(nodes.filter(F.col("role").isin("user", "assistant")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return split.oversized_items(load(spark, folder, "memories"), "memory_id", "content")


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    pieces = split.split_oversized(load(spark, folder, "memories"), "memory_id", "content")
    return pieces.dropDuplicates(["memory_id", "piece", "start", "end"])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.defective_pairs(load(spark, folder, "sidecar_turns"))


def _linked(spark: SparkSession, folder: str) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    return (
        neardup.similar_texts(load(spark, folder, "memories"), "memory_id", "content", run=5, least=100, threshold=0.6),
        neardup.similar_texts(load(spark, folder, "hooks"), "hook_id", "summary_title", run=3, least=12, threshold=0.6, exact=True),
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    content, title = (neardup.expand_links(*x) for x in _linked(spark, folder))
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("a").alias("key_a"), F.col("b").alias("key_b"))
    return named(content, "content").unionByName(named(title, "title"))


def p4_links(spark: SparkSession, folder: str) -> DataFrame:
    """Each memory (kind content) and hook (kind title) with its representative and the representative's number of links."""

    def counted(kind, links, members):
        ends = links.select(F.explode(F.array("a", "b")).alias("representative")).groupBy("representative").agg(F.count("*").alias("links"))
        return members.join(ends, "representative", "left").select(F.lit(kind).alias("kind"), F.col("id").alias("key"), "representative", F.coalesce("links", F.lit(0)).alias("links"))

    content, title = _linked(spark, folder)
    return counted("content", *content).unionByName(counted("title", *title))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return knn.sound_vectors(load(spark, folder, "hook_vectors"), "hook_id", "vector", "embedded_at", 64)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    near = knn.nearest_vectors(_vectors(spark, folder), k=5, min_cosine=0.9)
    return knn.similar_pairs(near, 0.9).select(F.col("a").alias("hook_a"), F.col("b").alias("hook_b"))


def p5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest of a stated query set, the hooks whose hash is divisible by 20, among all hooks."""
    vectors = materialize(_vectors(spark, folder), "unit")
    return knn.nearest_vectors(vectors, vectors.filter("pmod(xxhash64(id), 20) = 0").select("id"), k=5)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(load(spark, folder, "documents"), "doc_id", "text")


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """A digest of each document's ids decoded again, which must be that of its text."""
    rows = tokens.decode_corpus(p7_ids(spark, folder), "doc_id", "ids")
    return rows.select("doc_id", F.md5("text").alias("digest"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(load(spark, folder, "documents"), "doc_id", "text", capacity=2048)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.container_fill(p8_containers(spark, folder), 2048)


def p8_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Documents laid into containers; documents whose tokens are not all there; containers beyond capacity; documents split though they fit; whether containers are 98 % full."""
    documents = load(spark, folder, "documents")
    packed = materialize(packing.pack_documents(documents, "doc_id", "text", capacity=2048), "packed")
    sizes = tokens.count_tokens(documents.select("doc_id", "text"), "doc_id", "text").withColumnRenamed("tokens", "size")
    placed = packed.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    one = sizes.join(placed, "doc_id", "left").agg(
        F.count("pieces").alias("documents"), F.count_if(~F.col("size").eqNullSafe(F.col("tokens"))).alias("lost"), F.count_if((F.col("size") <= 2048) & (F.col("pieces") > 1)).alias("split")
    )
    boxes = packed.groupBy("container").agg(F.sum("tokens").alias("n")).filter("n > 0").agg(F.count_if(F.col("n") > 2048).alias("overfull"), (F.sum("n") >= 0.98 * 2048 * (F.count("*") - 1)).alias("full"))
    return one.crossJoin(boxes)  # one row each


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    model = level.train_level_model(load(spark, folder, "level_samples"))
    return level.reading_levels(load(spark, folder, "documents"), "doc_id", "text", model)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder).select("doc_id", "grade")


def p9_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Number of documents and mean score by source and grade."""
    graded = _levels(spark, folder).join(load(spark, folder, "documents").select("doc_id", "source"), "doc_id")
    return graded.groupBy("source", "grade").agg(F.count("*").alias("documents"), F.round(F.avg("score"), 4).alias("mean_score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_conversations, p1_paths, p2_found, p2_pieces, p3_found, p4_found, p4_links, p5_found, p5_neighbours,
        p7_ids, p7_round_trip, p8_containers, p8_fill, p8_invariants, p9_found, p9_by_source,
    )
}

_P1_SQL = r"""
WITH latest AS (
  SELECT id, session_id, lower(trim(type, chr(9) || chr(10) || chr(13) || ' ')) AS role, seq, data
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at DESC) AS n FROM session_messages)
  WHERE n = 1 AND trim(coalesce(session_id, '')) <> ''
), parsed AS (
  SELECT id, session_id, role, seq, coalesce(json_valid(data), false) AS valid,
    CASE WHEN json_valid(data) THEN data END AS j
  FROM latest
), speakers AS (
  SELECT *, j->>'$.parent' AS parent,
    regexp_matches(coalesce(j->>'$.text', ''), '[\p{L}\p{N}]')
    OR coalesce(len(list_filter(CAST(j->'$.content' AS JSON[]), lambda x: x->>'$.type' = 'text'
        AND regexp_matches(coalesce(x->>'$.text', ''), '[\p{L}\p{N}]'))) > 0, false) AS words
  FROM parsed WHERE role IN ('user', 'assistant')
), broken AS (
  SELECT session_id FROM speakers WHERE NOT valid OR seq IS NULL
  UNION SELECT session_id FROM speakers GROUP BY session_id, seq HAVING count(*) > 1
  UNION SELECT c.session_id FROM speakers c LEFT JOIN speakers p
    ON c.parent = p.id AND c.session_id = p.session_id AND p.role = 'user'
    WHERE c.parent IS NOT NULL AND p.id IS NULL
), said AS (
  SELECT session_id, role, row_number() OVER w AS n, lead(role) OVER w AS next_role
  FROM speakers WHERE words WINDOW w AS (PARTITION BY session_id ORDER BY seq)
), spoken AS (
  SELECT session_id, max(CASE WHEN n = 1 THEN role END) AS first_role,
    bool_or(role = 'user' AND coalesce(next_role, '') <> 'assistant') AS unanswered
  FROM said GROUP BY session_id
)
SELECT session_id, defect FROM (
  SELECT s.session_id, CASE WHEN b.session_id IS NOT NULL THEN 'broken' WHEN w.session_id IS NULL THEN 'empty'
    WHEN first_role = 'assistant' THEN 'broken' WHEN unanswered THEN 'missing_reply' END AS defect
  FROM (SELECT DISTINCT session_id FROM latest) s LEFT JOIN broken b USING (session_id) LEFT JOIN spoken w USING (session_id)
) WHERE defect IS NOT NULL
"""

_P2_SQL = r"""
WITH texts AS (
  SELECT DISTINCT memory_id, content FROM memories WHERE content IS NOT NULL
), large AS (
  SELECT * FROM texts
  WHERE length(content) / 4 + 1.25 * len(regexp_extract_all(content, '[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]')) > 1000
), stretches AS (
  SELECT memory_id, unnest(string_split(regexp_replace(regexp_replace(content, '([\n。！？])', '\1' || chr(1), 'g'), '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1))) AS s
  FROM large
)
SELECT memory_id, CASE WHEN max(length(s) / 4 + 1.25 * len(regexp_extract_all(s, '[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]'))) > 920
  THEN 'forced' ELSE 'boundary' END AS cut
FROM stretches GROUP BY memory_id
"""

# The pieces one after the other, over the prefix sums (in quarter tokens) and boundaries of each text as lists.
_P2_PIECES_SQL = r"""
WITH RECURSIVE large AS (
  SELECT memory_id, content, row_number() OVER () AS k FROM (SELECT DISTINCT memory_id, content FROM memories WHERE content IS NOT NULL)
  WHERE length(content) / 4 + 1.25 * len(regexp_extract_all(content, '{W}')) > 1000
), chars AS (
  SELECT k, i, substring(content, i, 1) AS c, substring(content, i + 1, 1) AS d, i = length(content) AS last
  FROM (SELECT k, content, unnest(range(1, length(content) + 1)) AS i FROM large)
), sums AS (
  SELECT k, i, sum(CASE WHEN regexp_matches(c, '{W}') THEN 6 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS s,
    last OR c IN (chr(10), '。', '！', '？') OR (c IN ('.', '!', '?') AND regexp_matches(d, '^[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')) AS ends
  FROM chars
), texts AS (
  SELECT k, list_concat([0], list(s::BIGINT ORDER BY i)) AS sums, list_concat([0], list(i ORDER BY i) FILTER (ends)) AS bounds, max(i) AS n FROM sums GROUP BY k
), pieces AS (
  SELECT k, -1 AS piece, 0::BIGINT AS a, 0::BIGINT AS b, false AS hard FROM texts
  UNION ALL
  SELECT k, piece + 1, x, CASE WHEN h THEN reach ELSE bound END, h FROM (
    SELECT *, bound < n AND (bound <= b OR sums[bound + 1] - sums[x + 1] <= 320) AS h FROM (
      SELECT *, list_last(list_filter(bounds, lambda e: e <= reach)) AS bound FROM (
        SELECT *, len(list_filter(sums, lambda v: v <= sums[x + 1] + 4000)) - 1 AS reach FROM (
          SELECT t.*, p.piece, p.b, len(list_filter(t.sums, lambda v: v < t.sums[p.b + 1] - 320)) AS x
          FROM pieces p JOIN texts t USING (k) WHERE p.b < t.n))))
)
SELECT memory_id, piece::INTEGER AS piece, count(*) OVER (PARTITION BY k)::INTEGER AS pieces, a::INTEGER AS "start", b::INTEGER AS "end",
  ((sums[b + 1] - sums[a + 1]) / 4)::DOUBLE AS tokens, hard,
  (list_max(list_transform(range(2, len(bounds) + 1), lambda i: sums[bounds[i] + 1] - sums[bounds[i - 1] + 1])) / 4)::DOUBLE AS widest, substring(content, a + 1, b - a) AS piece_text
FROM pieces JOIN texts USING (k) JOIN large USING (k) WHERE piece >= 0
""".replace("{W}", r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]")

# Roots by a walk along the parents; turns by a running number of user messages.
_P1_CONVERSATIONS_SQL = _P1_SQL.rsplit("SELECT session_id, defect FROM (", 1)[0].replace("WITH latest", "WITH RECURSIVE latest").rstrip() + r""", judged AS (
  SELECT s.session_id, b.session_id IS NULL AND w.session_id IS NOT NULL AND first_role <> 'assistant' AND NOT unanswered AS sound
  FROM (SELECT DISTINCT session_id FROM latest) s LEFT JOIN broken b USING (session_id) LEFT JOIN spoken w USING (session_id)
), up AS (
  SELECT session_id, id, parent AS top, 1 AS hops FROM speakers WHERE parent IS NOT NULL
  UNION ALL SELECT u.session_id, u.id, p.parent, hops + 1 FROM up u JOIN speakers p ON u.session_id = p.session_id AND u.top = p.id WHERE p.parent IS NOT NULL AND hops < 1000
), roots AS (SELECT session_id, id, arg_max(top, hops) AS root FROM up GROUP BY session_id, id),
texts AS (
  SELECT s.session_id, s.id, s.role, s.seq, CASE WHEN r.id IS NOT NULL THEN root WHEN s.role = 'user' THEN s.id END AS root,
    array_to_string(list_filter(list_concat([j->>'$.text'], CASE WHEN json_type(j->'$.content') = 'ARRAY' THEN list_transform(list_filter(CAST(j->'$.content' AS JSON[]), lambda x: x->>'$.type' = 'text'), lambda x: x->>'$.text') ELSE [] END), lambda x: x IS NOT NULL), chr(10)) AS text
  FROM speakers s JOIN judged g ON s.session_id = g.session_id AND g.sound LEFT JOIN roots r ON s.session_id = r.session_id AND s.id = r.id WHERE words
), numbered AS (SELECT *, sum((role = 'user')::INTEGER) OVER (PARTITION BY session_id ORDER BY seq)::BIGINT AS turn FROM texts)
SELECT session_id, turn, max(seq) FILTER (role = 'user') AS user_seq, max(text) FILTER (role = 'user') AS user_message, coalesce(string_agg(text, chr(10) ORDER BY seq) FILTER (role <> 'user'), '') AS llm_message,
  coalesce(arg_min_null(root, seq) FILTER (role <> 'user'), max(root) FILTER (role = 'user')) AS root_id
FROM numbered GROUP BY session_id, turn
"""

_P1_PATHS_SQL = r"""
WITH RECURSIVE n AS (
  SELECT session_id, id, lower(trim(type, chr(9) || chr(10) || chr(13) || ' ')) AS role, CASE WHEN json_valid(data) THEN data->>'$.parent' END AS parent
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at DESC) AS k FROM session_messages) WHERE k = 1 AND trim(coalesce(session_id, '')) <> ''
), s AS (SELECT * FROM n WHERE role IN ('user', 'assistant')),
walk AS (
  SELECT session_id, id AS leaf, id, parent, 0 AS up FROM s l WHERE NOT EXISTS (FROM s c WHERE c.session_id = l.session_id AND c.parent = l.id)
  UNION ALL SELECT w.session_id, leaf, p.id, p.parent, up + 1 FROM walk w JOIN s p ON w.session_id = p.session_id AND w.parent = p.id WHERE up < 1000
), whole AS (SELECT session_id, leaf, max(up) AS depth FROM walk GROUP BY session_id, leaf HAVING bool_or(parent IS NULL) AND max(up) < 1000)
SELECT w.session_id, w.leaf, (depth - up)::BIGINT AS position, w.id FROM walk w JOIN whole USING (session_id, leaf)
"""

_P4_SQL = r"""
WITH texts AS (
  SELECT DISTINCT 'content' AS kind, memory_id AS id, regexp_replace(lower(content), '[^\p{L}\p{N}]', '', 'g') AS t, 5 AS n, 100 AS least FROM memories WHERE memory_id IS NOT NULL AND content IS NOT NULL
  UNION ALL SELECT DISTINCT 'title', hook_id, regexp_replace(lower(summary_title), '[^\p{L}\p{N}]', '', 'g'), 3, 12 FROM hooks WHERE hook_id IS NOT NULL AND summary_title IS NOT NULL
), long AS (SELECT DISTINCT kind, id, t, n FROM texts WHERE length(t) >= least),
sets AS (SELECT kind, t, row_number() OVER () AS k, list_distinct(list_transform(range(1, length(t) - n + 2), lambda i: substring(t, i, n))) AS runs FROM (SELECT DISTINCT kind, t, n FROM long)),
runs AS (SELECT kind, k, len(runs) AS size, unnest(runs) AS run FROM sets),
met AS (SELECT kind, a.k AS a, b.k AS b, any_value(a.size) + any_value(b.size) AS sizes, count(*) AS common FROM runs a JOIN runs b USING (kind, run) WHERE a.k < b.k GROUP BY kind, a.k, b.k),
similar_sets AS (SELECT a, b FROM met WHERE common >= 0.6 * (sizes - common) - 1e-9 UNION ALL SELECT k, k FROM sets),
named AS (SELECT l.kind, l.id, s.k FROM long l JOIN sets s ON l.kind = s.kind AND l.t = s.t)
SELECT DISTINCT x.kind, least(x.id, y.id) AS key_a, greatest(x.id, y.id) AS key_b FROM similar_sets p JOIN named x ON p.a = x.k JOIN named y ON p.b = y.k WHERE x.id <> y.id
"""

# One representative for each set of runs; links between representatives.
_P4_LINKS_SQL = _P4_SQL.split("SELECT DISTINCT x.kind", 1)[0].rstrip() + r""",
classes AS (SELECT kind, k, array_to_string(list_sort(runs), ' ') AS class FROM sets),
members AS (SELECT DISTINCT n.kind, n.id, c.class FROM named n JOIN classes c USING (kind, k)),
heads AS (SELECT kind, class, min(id) AS representative FROM members GROUP BY kind, class),
links AS (SELECT DISTINCT c.kind, c.class, d.class AS other FROM similar_sets p JOIN classes c ON p.a = c.k JOIN classes d ON p.b = d.k WHERE c.class <> d.class),
ends AS (SELECT kind, class, count(*) AS links FROM (SELECT kind, class, other FROM links UNION SELECT kind, other, class FROM links) GROUP BY kind, class)
SELECT m.kind, m.id AS key, h.representative, coalesce(e.links, 0) AS links FROM members m JOIN heads h USING (kind, class) LEFT JOIN ends e USING (kind, class)
"""

_P5_SQL = r"""
WITH last AS (SELECT hook_id AS id, arg_max(vector, (embedded_at, vector)) AS v FROM hook_vectors WHERE hook_id IS NOT NULL GROUP BY hook_id),
sound AS (SELECT id, CAST(v AS DOUBLE[64]) AS v FROM last WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
scored AS (SELECT a.id AS a, b.id AS b, array_cosine_similarity(a.v, b.v) AS c FROM sound a JOIN sound b ON a.id <> b.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM scored)
SELECT DISTINCT least(a, b) AS hook_a, greatest(a, b) AS hook_b FROM ranked WHERE k <= 5 AND c >= 0.9
"""

_P7_SQL = "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents"
_P8_SQL = 'SELECT count(*) AS documents, 0::BIGINT AS lost, 0::BIGINT AS split, 0::BIGINT AS overfull, true AS "full" FROM documents'

SQL: dict[str, str] = {
    "p1_found": _P1_SQL, "p1_conversations": _P1_CONVERSATIONS_SQL, "p1_paths": _P1_PATHS_SQL, "p2_found": _P2_SQL, "p2_pieces": _P2_PIECES_SQL, "p4_found": _P4_SQL, "p4_links": _P4_LINKS_SQL,
    "p5_found": _P5_SQL, "p7_round_trip": _P7_SQL, "p8_invariants": _P8_SQL,
}
