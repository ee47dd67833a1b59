"""Column functions over text: token estimates, tokenisers, n-grams, similarity, predicates."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import CHITCHAT, CJK_NARROW, CJK_SEARCH, CJK_WIDE, OPPOSITES, QUESTION_MARKS, STOP_WORDS, SUBAGENT_MARKS, TOKENIZER_FACTORS

_C = Column | str


def _col(x: _C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def count_matches(text: _C, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(0)))


def estimate_tokens(text: _C) -> Column:
    """Characters / 4 plus 1.25 for each CJK character, rounded half up; 0 for null and empty texts."""
    text = F.coalesce(_col(text), F.lit(""))
    cjk = F.length(text) - F.length(F.regexp_replace(text, f"[{CJK_WIDE}]", ""))
    return F.floor(F.length(text) * 0.25 + cjk * 1.25 + 0.5).cast("long")


def char_tokens(text: _C) -> Column:
    """1.5 a CJK character, 1.3 a run of Latin letters and digits, 0.5 any other visible character, each rounded."""
    text = F.coalesce(_col(text), F.lit(""))
    cjk = count_matches(text, f"[{CJK_WIDE}]")
    latin = count_matches(text, "[A-Za-z0-9]+")
    other = F.length(F.regexp_replace(text, rf"[{CJK_WIDE}A-Za-z0-9\s]", ""))
    half_up = lambda x: F.floor(x + 0.5).cast("long")
    return half_up(cjk * 1.5) + half_up(latin * 1.3) + half_up(other * 0.5)


def cjk_ratio(text: _C) -> Column:
    """Share of CJK characters among those that are not white space; 0 if there are none."""
    bare = F.regexp_replace(_col(text), r"\s", "")
    n = F.length(bare)
    return F.when(n > 0, (n - F.length(F.regexp_replace(bare, f"[{CJK_NARROW}]", ""))) / n).otherwise(F.lit(0.0))


def text_language(text: _C) -> Column:
    """chinese or latin by six tenths of the letters, else mixed; latin without letters."""
    text = _col(text)
    cjk, latin = count_matches(text, f"[{CJK_NARROW}]"), count_matches(text, "[A-Za-z]")
    total = cjk + latin
    return (
        F.when(total == 0, "latin").when(cjk / total >= 0.6, "chinese").when(latin / total >= 0.6, "latin").otherwise("mixed")
    )


def search_tokens(text: _C, stop_words: bool = True) -> Column:
    """Runs of ASCII letters and digits in lower case, and single CJK characters, without stop words."""
    tokens = F.regexp_extract_all(F.lower(_col(text)), F.lit(f"[a-z0-9]+|[{CJK_SEARCH}]"), F.lit(0))
    return F.filter(tokens, lambda t: ~t.isin(*STOP_WORDS)) if stop_words else tokens


def query_terms(query: str) -> dict[str, int]:
    """Terms of a query, cut as search_tokens cuts texts, with their number."""
    out: dict[str, int] = {}
    for t in re.findall(f"[a-z0-9]+|[{CJK_SEARCH}]", query.lower()):
        if t not in STOP_WORDS:
            out[t] = out.get(t, 0) + 1
    return out


def ngrams(text: _C, n: int) -> Column:
    """The set of runs of n characters; a shorter text is its own run, an empty one has none."""
    text = _col(text)
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(runs)).when(text == "", F.array().cast("array<string>")).otherwise(F.array(text))


def word_set(text: _C) -> Column:
    """The set of runs of letters and digits, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection by that of the union; 0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def char_similarity(a: _C, b: _C) -> Column:
    """Jaccard of the code points; 0 if either is empty, 1 if equal."""
    a, b = _col(a), _col(b)
    chars = lambda x: F.array_distinct(F.split(x, ""))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(jaccard(chars(a), chars(b)))


def _blend(a: Column, b: Column, share: Column) -> Column:
    return share * jaccard(ngrams(a, 2), ngrams(b, 2)) + (1 - share) * jaccard(word_set(a), word_set(b))


def word_similarity(a: _C, b: _C) -> Column:
    """Jaccard of words, of character pairs, or both weighted, by the mean share of CJK."""
    a, b = _col(a), _col(b)
    share = (cjk_ratio(a) + cjk_ratio(b)) / 2
    return (
        F.when((a == "") | (b == ""), 0.0)
        .when(a == b, 1.0)
        .when(share >= 0.6, jaccard(ngrams(a, 2), ngrams(b, 2)))
        .when(share <= 0.4, jaccard(word_set(a), word_set(b)))
        .otherwise(_blend(a, b, share))
    )


def fact_similarity(a: _C, b: _C) -> Column:
    """Equal 1, contained 0.9, else by the longer text's language; outer blanks and case do not count."""
    a, b = F.lower(F.trim(_col(a))), F.lower(F.trim(_col(b)))
    shorter = F.when(F.octet_length(a) <= F.octet_length(b), a).otherwise(b)
    longer = F.when(F.octet_length(a) <= F.octet_length(b), b).otherwise(a)
    language = text_language(F.when(F.length(a) >= F.length(b), a).otherwise(b))
    return (
        F.when((a == "") | (b == ""), 0.0)
        .when(a == b, 1.0)
        .when(F.contains(longer, shorter), 0.9)
        .when(language == "chinese", jaccard(ngrams(a, 2), ngrams(b, 2)))
        .when(language == "latin", 0.6 * jaccard(word_set(a), word_set(b)) + 0.4 * jaccard(ngrams(a, 3), ngrams(b, 3)))
        .otherwise(_blend(a, b, (cjk_ratio(a) + cjk_ratio(b)) / 2))
    )


def opposes(a: _C, b: _C) -> Column:
    """One text holds the positive and the other the negative word of a pair; the negative word is looked for first."""
    a, b = F.lower(F.trim(_col(a))), F.lower(F.trim(_col(b)))
    table = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(n).alias("n")) for p, n in OPPOSITES))
    side = lambda x, w: F.when(F.contains(x, w["n"]), -1).when(F.contains(x, w["p"]), 1).otherwise(0)
    return F.exists(table, lambda w: side(a, w) * side(b, w) == -1)


def is_question(text: _C) -> Column:
    """Ends in a question mark, or holds a word that asks."""
    text = _col(text)
    return text.rlike(r"[?？]\s*$") | text.rlike("|".join(QUESTION_MARKS))


def is_subagent_tool(name: _C) -> Column:
    name = F.lower(F.trim(_col(name)))
    return (name == "task") | name.rlike("|".join(SUBAGENT_MARKS))


def is_chitchat(user: _C, answer: _C, custom: tuple[str, ...] = ()) -> Column:
    """Both texts empty, a user text of three characters at most, or one of ten at most that begins with a set phrase."""
    user, answer = F.trim(F.coalesce(_col(user), F.lit(""))), F.trim(F.coalesce(_col(answer), F.lit("")))
    low = F.lower(user)
    phrase = reduce(lambda x, y: x | y, (F.startswith(low, F.lit(p)) for p in (*CHITCHAT, *custom)))
    return ((user == "") & (answer == "")) | ((user != "") & (F.length(user) <= 3)) | ((user != "") & (F.length(user) <= 10) & phrase)


def title_of(text: _C, fallback: _C) -> Column:
    """The first 80 characters, always followed by three dots; without text the fallback."""
    text = _col(text)
    return F.when(F.length(F.trim(text)) > 0, F.concat(F.substring(text, 1, 80), F.lit("..."))).otherwise(_col(fallback))


def truncate(text: _C, n: int, mark: str = "…") -> Column:
    text = _col(text)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def normalise_answer(text: _C) -> Column:
    """Lower case without commas, punctuation, articles and repeated blanks."""
    x = F.regexp_replace(F.lower(F.regexp_replace(_col(text), ",", "")), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\b(a|an|the|and)\b", " "), r"\s+", " "))


def parse_score(text: _C) -> Column:
    """The score of a reply, from 0 to 100: the reply itself, else what follows the last colon or blank of the first line where that is a number, else the first run of digits, points and dashes; null without one."""
    number = lambda x: F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), x.cast("double"))
    bare = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    text = bare(_col(text))
    after = lambda line, mark: F.when(F.contains(line, F.lit(mark)), number(bare(F.substring_index(line, mark, -1))))
    lines = F.transform(F.split(text, "\r?\n"), bare)
    tails = F.filter(F.transform(lines, lambda x: F.coalesce(*(after(x, m) for m in ("：", ":", " ")))), lambda x: x.isNotNull())
    score = F.coalesce(number(text), F.get(tails, F.lit(0)), number(F.regexp_extract(text, r"([0-9.\-]+)", 1)))
    return F.when(score.isNotNull(), F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)))


def fenced_json(text: _C) -> Column:
    """What stands between ```json (or ```) and ```, else the trimmed text."""
    inner = F.regexp_extract(_col(text), r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(inner != "", inner).otherwise(F.trim(_col(text)))


def dialogue_time(text: _C) -> Column:
    """`2023/05/20 (Sat) 02:21` or `1:56 pm on 8 May, 2023` as a timestamp; else null."""
    text = _col(text)
    first = F.try_to_timestamp(F.regexp_replace(text, r"\s*\([A-Za-z]+\)\s*", " "), F.lit("yyyy/MM/dd HH:mm"))
    second = F.try_to_timestamp(F.regexp_replace(F.upper(text), r"^(\d+:\d+) ([AP]M) ON (\d+) (\w)(\w*), (\d+)$", "$1 $2 $3 $4$5 $6"), F.lit("h:mm a d MMMM yyyy"))
    third = F.try_to_timestamp(F.concat_ws(" ", F.regexp_extract(text, r"^(\d+:\d+)", 1), F.upper(F.regexp_extract(text, r"(?i)([ap]m)", 1)), F.regexp_extract(text, r"on (\d+ \w+), (\d+)", 1), F.regexp_extract(text, r"on (\d+ \w+), (\d+)", 2)), F.lit("h:mm a d MMMM yyyy"))
    return F.coalesce(first, second, third)


def week_key(at: _C) -> Column:
    """ISO year and week, as 2025-W07."""
    at = _col(at)
    return F.concat(F.date_part(F.lit("YEAROFWEEK"), at).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(at).cast("string"), 2, "0"))


def month_key(at: _C) -> Column:
    return F.date_format(_col(at), "yyyy-MM")


def relevance(query: str, title: Column, tags: Column, facts: Column | None = None, entities: Column | None = None, anchors: Column | None = None, abstract: Column | None = None) -> Column:
    """Per word of the query: 3 for the title, 2 for any tag, entity and anchor each, 1 for any fact and for the abstract, where they contain it."""
    none = F.array().cast("array<string>")

    def points(word: str) -> Column:
        holds = lambda x: F.contains(F.lower(x), F.lit(word))
        texts = [(title, 3), (abstract, 1)]
        lists = [(tags, 2), (entities, 2), (anchors, 2), (facts, 1)]
        found = [F.when(holds(F.coalesce(x, F.lit(""))), n).otherwise(0) for x, n in texts if x is not None]
        return sum((F.when(F.exists(F.coalesce(x, none), holds), n).otherwise(0) for x, n in lists if x is not None), sum(found, F.lit(0)))

    return sum((points(w) for w in query.lower().split()), F.lit(0)).cast("long")


def edit_section(document: _C, section: str, text: str | None, mode: str = "replace") -> Column:
    """Replaces, appends to or deletes what stands between `<!-- section -->` and `<!-- /section -->`."""
    document = _col(document)
    pattern = rf"(?s)(<!-- {section} -->\n?)(.*?)(\n?<!-- /{section} -->)"
    if mode == "delete":
        return F.regexp_replace(document, pattern + r"\n?", "")
    new = (text or "").replace("\\", "\\\\").replace("$", "\\$")
    there = document.rlike(pattern)
    edited = F.regexp_replace(document, pattern, f"$1{new}$3" if mode == "replace" else f"$1$2\n{new}$3")
    return F.when(there, edited).otherwise(F.concat(document, F.lit(f"\n<!-- {section} -->\n{text or ''}\n<!-- /{section} -->\n")))


def scaled_tokens(count: Column, tokenizer: str) -> Column:
    """The count of an encoding, scaled to stand for another tokenizer and rounded half up."""
    factor = TOKENIZER_FACTORS[tokenizer]
    return count if factor == 1 else F.floor(count * F.lit(factor) + 0.5).cast("long")


def search_query(*parts: Column) -> Column:
    """What is filled of the parts (texts, or arrays of texts), joined by blanks."""
    return F.concat_ws(" ", *(F.when(p != "", p) for p in parts))


def answer_tokens(text: _C) -> Column:
    """Runs of letters, digits and marks, and every other visible character, in lower case."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}\s]"), F.lit(0))


def has_answer(text: _C, answers: Column) -> Column:
    """The tokens of one of the answers stand next to each other in those of the text; an answer without tokens is in every text. Composed and decomposed letters differ."""
    joined = lambda x: F.concat(F.lit(" "), F.array_join(answer_tokens(x), " "), F.lit(" "))
    near = joined(_col(text))
    return F.coalesce(F.exists(F.filter(answers, lambda a: a.isNotNull()), lambda a: F.contains(near, joined(a)) | (F.size(answer_tokens(a)) == 0)), F.lit(False))


def piece_tokens(text: _C, model: str | None = None) -> Column:
    """Number of pieces by a SentencePiece model file, in batches; char_tokens where there is no model or library."""
    model = model or os.environ.get("MNEMOSPARK_PIECE_MODEL")
    try:
        import sentencepiece  # noqa: F401
    except ImportError:
        model = None
    if not model or not os.path.exists(model):
        return char_tokens(text)

    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        codec = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in texts:
            yield pd.Series([len(x) for x in codec.encode(batch.fillna("").tolist(), num_threads=1)], dtype="int64")

    return count(_col(text))
