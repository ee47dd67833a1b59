"""SQL expressions for DuckDB, each the counterpart of a column function."""

from __future__ import annotations

from ..vocab import CHITCHAT, OPPOSITES, QUESTION_MARKS, STOP_WORDS, SUBAGENT_MARKS

_WIDE = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}"
_NARROW = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}"
_SEARCH = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}"


def strings(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def tokens(x: str) -> str:
    return f"floor(length(coalesce({x}, '')) * 0.25 + {count(f'''coalesce({x}, '')''', f'[{_WIDE}]')} * 1.25 + 0.5)::BIGINT"


def char_tokens(x: str) -> str:
    x = f"coalesce({x}, '')"
    other = f"length(regexp_replace({x}, '[{_WIDE}A-Za-z0-9\\s]', '', 'g'))"
    cjk, latin = count(x, f"[{_WIDE}]"), count(x, "[A-Za-z0-9]+")
    return f"(floor({cjk} * 1.5 + 0.5) + floor({latin} * 1.3 + 0.5) + floor({other} * 0.5 + 0.5))::BIGINT"


def cjk_ratio(x: str) -> str:
    bare = f"regexp_replace({x}, '\\s', '', 'g')"
    return f"CASE WHEN length({bare}) > 0 THEN {count(bare, f'[{_NARROW}]')} / length({bare})::DOUBLE ELSE 0.0::DOUBLE END"


def language(x: str) -> str:
    c, a = count(x, f"[{_NARROW}]"), count(x, "[A-Za-z]")
    return f"CASE WHEN {c} + {a} = 0 THEN 'latin' WHEN {c} / ({c} + {a}) >= 0.6 THEN 'chinese' WHEN {a} / ({c} + {a}) >= 0.6 THEN 'latin' ELSE 'mixed' END"


def search_tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+|[{_SEARCH}]'), lambda w: w NOT IN ({strings(STOP_WORDS)}))"


def ngrams(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) >= {n} THEN list_distinct(list_transform(range(1, length({x}) - {n - 2}), lambda i: substring({x}, i, {n}))) WHEN {x} = '' THEN [] ELSE [{x}] END"


def words(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'))"


def jaccard(a: str, b: str) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {union} > 0 THEN len(list_intersect({a}, {b})) / {union}::DOUBLE ELSE 0.0::DOUBLE END"


def char_similarity(a: str, b: str) -> str:
    chars = lambda x: f"list_distinct(string_split({x}, ''))"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 ELSE {jaccard(chars(a), chars(b))} END"


def _blend(a: str, b: str, share: str) -> str:
    return f"({share}) * ({jaccard(ngrams(a, 2), ngrams(b, 2))}) + (1 - ({share})) * ({jaccard(words(a), words(b))})"


def word_similarity(a: str, b: str) -> str:
    share = f"(({cjk_ratio(a)}) + ({cjk_ratio(b)})) / 2"
    return (
        f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 WHEN {share} >= 0.6 THEN {jaccard(ngrams(a, 2), ngrams(b, 2))} "
        f"WHEN {share} <= 0.4 THEN {jaccard(words(a), words(b))} ELSE {_blend(a, b, share)} END"
    )


def fact_similarity(a: str, b: str) -> str:
    a, b = f"lower(trim({a}, ' '))", f"lower(trim({b}, ' '))"
    longer = f"CASE WHEN length({a}) >= length({b}) THEN {a} ELSE {b} END"
    inside = f"CASE WHEN strlen({a}) <= strlen({b}) THEN contains({b}, {a}) ELSE contains({a}, {b}) END"
    share = f"(({cjk_ratio(a)}) + ({cjk_ratio(b)})) / 2"
    latin = f"0.6 * ({jaccard(words(a), words(b))}) + 0.4 * ({jaccard(ngrams(a, 3), ngrams(b, 3))})"
    kind = language(f"({longer})")
    return (
        f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 WHEN {inside} THEN 0.9 WHEN ({kind}) = 'chinese' THEN {jaccard(ngrams(a, 2), ngrams(b, 2))} "
        f"WHEN ({kind}) = 'latin' THEN {latin} ELSE {_blend(a, b, share)} END"
    )


def opposes(a: str, b: str) -> str:
    table = ", ".join(f"{{'p': '{p}', 'n': '{n}'}}" for p, n in OPPOSITES)
    side = lambda x: f"CASE WHEN contains(lower({x}), w.n) THEN -1 WHEN contains(lower({x}), w.p) THEN 1 ELSE 0 END"
    return f"len(list_filter([{table}], lambda w: ({side(a)}) * ({side(b)}) = -1)) > 0"


def question(x: str) -> str:
    return f"(regexp_matches({x}, '[?？]\\s*$') OR regexp_matches({x}, '{'|'.join(QUESTION_MARKS)}'))"


def chitchat(user: str, answer: str) -> str:
    u, a = f"trim(coalesce({user}, ''), ' ')", f"trim(coalesce({answer}, ''), ' ')"
    phrase = " OR ".join(f"starts_with(lower({u}), '{p}')" for p in CHITCHAT)
    return f"(({u} = '' AND {a} = '') OR ({u} <> '' AND length({u}) <= 3) OR ({u} <> '' AND length({u}) <= 10 AND ({phrase})))"


def normalise(x: str) -> str:
    x = f"regexp_replace(lower(regexp_replace({x}, ',', '', 'g')), '[!-/:-@\\[-`{{-~]', '', 'g')"
    return f"trim(regexp_replace(regexp_replace({x}, '\\b(a|an|the|and)\\b', ' ', 'g'), '\\s+', ' ', 'g'), ' ')"


def token_f1(a: str, b: str) -> str:
    w = lambda x: f"list_filter(string_split({normalise(x)}, ' '), lambda w: w <> '')"
    p, t = w(a), w(b)
    same = f"list_sum(list_transform(list_distinct({p}), lambda x: least(len(list_filter({p}, lambda y: y = x)), len(list_filter({t}, lambda y: y = x)))))"
    return f"CASE WHEN coalesce({same}, 0) > 0 THEN 2.0 * {same} / (len({p}) + len({t})) ELSE 0.0 END::DOUBLE"


def exact_match(a: str, b: str) -> str:
    w = lambda x: f"list_sort(list_distinct(string_split({normalise(x)}, ' ')))"
    return f"{w(a)} = {w(b)}"


def relevance(query: str) -> str:
    parts = []
    for word in query.lower().split():
        parts.append(f"CASE WHEN contains(lower(coalesce(summary_title, '')), '{word}') THEN 3 ELSE 0 END")
        parts.append(f"CASE WHEN len(list_filter(coalesce(tags, []), lambda t: contains(lower(t), '{word}'))) > 0 THEN 2 ELSE 0 END")
    return f"({' + '.join(parts)})::BIGINT"


def message_tags(m: str) -> str:
    text, tools = f"coalesce({m}.text, '')", f"coalesce(len({m}.tool_calls), 0) > 0"
    code = f"(contains({text}, '```') OR coalesce(len({m}.file_changes), 0) > 0)"
    marks = " OR ".join(f"contains(lower(t.name), '{x}')" for x in SUBAGENT_MARKS)
    agent = f"coalesce(len(list_filter({m}.tool_calls, lambda t: lower(trim(t.name, ' ')) = 'task' OR {marks})), 0) > 0"
    rules = [
        (tools, "ToolCall"), (tools, "AgentTool"), (agent, "SubAgent"), (code, "CodeBlock"), (f"coalesce(length(trim({m}.thinking, ' ')), 0) > 0", "Thinking"),
        (f"contains({text}, 'http://') OR contains({text}, 'https://')", "Url"), (f"{question(text)} AND NOT {code}", "Question"),
    ]
    found = f"list_filter([{', '.join(f'''CASE WHEN {c} THEN '{n}' END''' for c, n in rules)}], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({found}) > 0 THEN {found} ELSE ['Text'] END"


def turn_tags() -> str:
    both = f"list_concat({message_tags('user_message')}, {message_tags('llm_message')})"
    first = f"list_filter({both}, lambda x, i: list_position({both}, x) = i)"
    rest = f"list_filter({first}, lambda x: x <> 'Text')"
    return f"CASE WHEN len({rest}) > 0 THEN {rest} ELSE {first} END"


def message_tokens(m: str, names: bool, least: int = 1) -> str:
    parts = [*(["t.name"] if names else []), "t.arguments", "t.result"]
    tools = f"coalesce(list_sum(list_transform({m}.tool_calls, lambda t: {' + '.join(tokens(p) for p in parts)})), 0)"
    return f"greatest({tokens(m + '.text')} + {tokens(m + '.thinking')} + {tools}, {least})"


def turn_tokens(names: bool = True) -> str:
    return f"({message_tokens('user_message', names)} + {message_tokens('llm_message', names)})::BIGINT"


def bm25(table: str, key: str, text: str, terms: dict[str, int], by: str | None = None) -> str:
    """`terms`: those of the query with their number, written out beside the query so that a wrong cut of it shows."""
    words = search_tokens(f"coalesce({text}, '')")
    keys = f"{key}, {by}" if by else key
    counts = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    stats = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    parts = " + ".join(
        f"{n} * ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / CASE WHEN avgdl > 0 THEN avgdl ELSE 1 END))"
        for i, n in enumerate(terms.values())
    )
    return (
        f"WITH w AS (SELECT {keys}, {words} AS w FROM {table}), d AS (SELECT {keys}, len(w) AS dl, {counts} FROM w), "
        f"s AS (SELECT {by + ', ' if by else ''}count(*) AS n, avg(dl) AS avgdl, {stats} FROM d {'GROUP BY ' + by if by else ''}), "
        f"scored AS (SELECT * FROM (SELECT {keys}, ({parts})::DOUBLE AS score FROM d {f'JOIN s USING ({by})' if by else 'CROSS JOIN s'}) WHERE score > 0)"
    )


def cosine(table: str, key: str, vector: str, query: list[float], normalised: bool = True) -> str:
    v = f"CAST({vector} AS DOUBLE[])"
    literal = "[" + ", ".join(f"{x!r}::DOUBLE" for x in query) + "]"
    function = "list_cosine_similarity" if normalised else "list_inner_product"
    return f"SELECT {key}, {function}({v}, {literal}) AS score FROM {table} WHERE len({vector}) = {len(query)}"
