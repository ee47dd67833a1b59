"""Defective prompt and answer pairs: empty, copied, refused, truncated or in another language."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize

_STAND_INS = {"nan", "none", "nil", "null", "nul", "undefined", "n/a", "na", "empty", "missing", "nothing", "no value", "not available"}

_LEAD_INS = re.compile(
    r"^(you asked|your question|the question|question|user|prompt|input|q|human|instruction|request|pregunta|frage|问题|用户|提问)\s*(was|is)?\s*[:：>\-]+\s*", re.I
)

# What a refusal says, and what may stand around it.
_REFUSES = re.compile(
    r"i (must|have to|need to) (refuse|decline)|i (won't|will not|wouldn't) be (writing|helping|answering|discussing)"
    r"|i (can't|cannot|can not|won't|will not) (help|assist|answer|do that|do this|discuss|provide|comply|write|share)"
    r"|(i'm|i am|am) (not able|unable|not allowed|not permitted) to (assist|help|answer|discuss|provide|comply|do that)"
    r"|i (don't|do not) feel comfortable|i('d| would) rather not|my guidelines (rule out|forbid|prevent)|not something i can do"
    r"|you (will|'ll) have to ask someone else|i (do not|don't) give advice|outside what i('m| am) allowed"
    r"|darf ich nichts sagen|kann ich (dir |ihnen )?(leider )?nicht (helfen|beantworten)|muss ich ablehnen|so etwas schreibe ich nicht|möchte ich nicht"
    r"|ne m'est pas permis|ne peux pas (vous |t')?(aider|répondre)|je dois (refuser|décliner)|préfère ne pas (aborder|répondre)|je n'écri(s|rai) pas"
    r"|no puedo (ayudar|responder|contestar)|no me está permitido|debo (rechazar|declinar)|prefiero no (entrar|hablar|responder)|no escribo"
    r"|我必须拒绝|无法(协助|帮助|回答|处理|提供)|我?不能(回答|协助|帮助|提供|处理)|没有权限(讨论|回答|处理)|超出了我(可以|能)?|恕我不能|我不便",
    re.I,
)
_AROUND = re.compile(
    r"^(is there (something|anything) (different|else)|(what|how) else can i|no exceptions here|please ask (a person|someone|an expert)|i hope you understand|(it|this) would break the"
    r"|let's (pick|choose|talk)|(that|this) request goes too far|sorry\b|i'm sorry\W*$|apologies\W*$|thank(s| you)\b"
    r"|frag mich gern|bitte wende dich|ich bitte um verständnis|tut mir leid|verzeihung|leider|vielleicht etwas"
    r"|adressez-vous|parlons d'autre|merci de votre compréhension|désolé|pardon|malheureusement|puis-je|autre chose"
    r"|consulta con|espero que lo|¿?hablamos de otra|lo siento|disculpa|por desgracia|¿?(hay|puedo)"
    r"|还有别的|希望您能|请咨询|换个话题|抱歉|对不起|不好意思|很遗憾|请谅解|敬请)",
    re.I,
)

_NUMBER_WORDS = {
    **dict(zip("two three four five six seven eight nine ten".split(), range(2, 11))),
    **dict(zip("zwei drei vier fünf sechs sieben acht neun zehn".split(), range(2, 11))),
    **dict(zip("deux trois quatre cinq six sept huit neuf dix".split(), range(2, 11))),
    **dict(zip("dos tres cuatro cinco seis siete ocho nueve diez".split(), range(2, 11))),
    **dict(zip("两 三 四 五 六 七 八 九 十".split(), range(2, 11))),
}
_NUMBER = re.compile(
    r"\b(" + "|".join(w for w in _NUMBER_WORDS if w.isascii() or w in ("fünf", "zwölf")) + r"|\d{1,2})\b|([两三四五六七八九十])(?=[个点部步项条种件])", re.I
)
_ITEM = re.compile(r"^\s*(?:[-*•–+]\s+(?:\d{1,2}[.:)]\s*)?|\(?\d{1,2}[.:)]\s*|（?[一二三四五六七八九十]）?[、.)）]\s*)")
_BULLET = re.compile(r"^\s*[-*•–+]\s+(?!\d{1,2}[.:)])")
_MARK = re.compile(r"(?:^|\s)(?:[-*•–+]\s+)?[(（]?(\d{1,2})[.:)）](?=\s)")
_BLOCK = re.compile(r"```.*?```", re.S)
_BARE_ITEM = re.compile(r"^\s*(?:[-*•–+](?:\s+\d{1,2}[.:)]?)?|\(?\d{1,2}[.:)]?|\()\s*$")
_ENDS = ".!?。！？…"
_CLOSERS = "\"'”’)）」』*_~`>"
_OPEN_WORDS = set(
    "the a an one each every our another any some this that these those its their of to in on at by for with from and or but then because unless until while since although near "
    "inside beside before after behind without despite within across during under der die das den dem des ein eine einen und oder mit ohne le la les un une des du de et ou avec sans "
    "el los las una y o con sin por para que".split()
)

_CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`", re.S)
# Scripts that name a language, or a family of languages.
_SCRIPTS = [
    ("ja", re.compile(r"[\u3040-\u30ff]")), ("ko", re.compile(r"[\u1100-\u11ff\uac00-\ud7af]")), ("cyrillic", re.compile(r"[\u0400-\u052f]")), ("greek", re.compile(r"[\u0370-\u03ff]")),
    ("arabic", re.compile(r"[\u0600-\u06ff]")), ("hebrew", re.compile(r"[\u0590-\u05ff]")), ("devanagari", re.compile(r"[\u0900-\u097f]")), ("thai", re.compile(r"[\u0e00-\u0e7f]")),
]
_HAN = re.compile(r"[㐀-䶿一-鿿]")
_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*|\n+")
_FUNCTION_WORDS = {
    "en": "the a an and or but of to in on at is are was were be been it its this that these we you i he she they our your my not do does did can could should would will how what why when which who please with without for from by after before each every another while because since unless had have has let if then there no yes into as".split(),
    "de": "der die das den dem des ein eine einen einem und oder aber nicht ist sind war im in mit ohne auf für von vor nach bei zum zur weil dass wenn warum wie was wer bitte ich du sie wir es kann kannst wird alle ganze letzten trotz während gemäß laut seit einer es gibt".split(),
    "fr": "le la les l un une des du de d et ou mais ne pas est sont dans en sur avec sans pour par avant après car que qui quoi pourquoi comment je tu il elle nous vous ce cette ces tout toute toutes si bien merci peux s depuis selon sous au aux y a".split(),
    "es": "el la los las un una unos unas de del y o pero no es son en con sin por para antes después porque que qué quién cómo cuál yo tú él ella nosotros su sus este esta todo toda todos todas si puedes lo al se desde según durante aunque hay favor hasta como".split(),
}
_OWNERS: dict[str, list[str]] = {}
for _name, _words in _FUNCTION_WORDS.items():
    for _w in _words:
        _OWNERS.setdefault(_w, []).append(_name)

_ASKED = [
    ("zh", re.compile(r"\b(?:in|into|to|auf|ins|en|au|al)\s+(?:chinese|mandarin|chinesisch\w*|chinois|chino)\b|(?:用|成|译为|以)\s*(?:中文|汉语|简体)", re.I)),
    ("en", re.compile(r"\b(?:in|into|to|auf|ins|en|al)\s+(?:english|englisch\w*|anglais|inglés)\b|(?:用|成|译为|以)\s*(?:英文|英语)", re.I)),
    ("de", re.compile(r"\b(?:in|into|to|auf|ins|en|al)\s+(?:german|deutsch\w*|allemand|alemán)\b|(?:用|成|译为|以)\s*(?:德文|德语)", re.I)),
    ("fr", re.compile(r"\b(?:in|into|to|auf|ins|en|al)\s+(?:french|französisch\w*|français|francés)\b|(?:用|成|译为|以)\s*(?:法文|法语)", re.I)),
    ("es", re.compile(r"\b(?:in|into|to|auf|ins|en|al)\s+(?:spanish|spanisch\w*|espagnol|español|castellano)\b|(?:用|成|译为|以)\s*(?:西班牙文|西班牙语)", re.I)),
]


_ALNUM = re.compile(r"[^\W_]")
_NOT_ALNUM = re.compile(r"[\W_]+")


def _bare(text: str) -> str:
    return _NOT_ALNUM.sub("", text.lower())


def is_empty(answer: str) -> bool:
    """No letter or digit, or only a stand-in for no value."""
    if not _ALNUM.search(answer):
        return True
    return answer.strip().strip("<>()[]{}\"'`.*_- ").lower() in _STAND_INS


def is_copy(prompt: str, answer: str) -> bool:
    """Nothing but the prompt, repeated, quoted, introduced, or a part of it."""
    p, a = _bare(prompt), _bare(answer)
    if not p or not a:
        return False
    # pieces of the prompt longer than a few words, in any layout
    if a in p:
        return len(a) >= min(len(p), 10) or len(a) * 2 >= len(p)
    rest = _bare(_LEAD_INS.sub("", answer.strip().lstrip("> \"'*“„«")))
    if rest in p and len(rest) * 3 >= len(p):
        return True
    if p in a:
        rest = a.replace(p, "")
        if _HAN.search(rest):
            return len(rest) <= 4 and _bare(_LEAD_INS.sub("", answer.strip())) != a
        return len(rest) <= 8
    lines = [_bare(_LEAD_INS.sub("", x.strip().lstrip(">*\"' "))) for x in answer.splitlines()]
    lines = [x for x in lines if x]
    return bool(lines) and sum(map(len, lines)) * 3 >= len(p) and all(x in p and len(x) >= 6 for x in lines)


def is_refusal(answer: str) -> bool:
    """Every sentence refuses or stands around a refusal, and one refuses."""
    if "```" in answer:
        return False
    refuses = False
    for sentence in _SENTENCE.split(answer.strip().replace("’", "'")):
        s = sentence.strip()
        if not s:
            continue
        if _REFUSES.search(s) and not re.search(r"\bbut (here|there|the|it)\b|\binstead\b", s, re.I):
            refuses = True
        elif not _AROUND.search(s):
            return False
    return refuses


def cut_item(text: str, cut: bool, cut_word: bool) -> bool:
    """The last list item, which ends in a letter or digit, is cut.

    It breaks off inside a word, as the neighbours of its last word among the
    words of all answers show, at a word that calls for another, or without the
    final mark of all other items; if the stop reason names a limit, also with
    fewer words than any other item.
    """
    *before, last = [x for x in text.split("\n") if x.strip()]
    words = last.split()
    word = words[-1].lower()
    if cut_word or word in _OPEN_WORDS or len(words) <= 2 and cut:
        return True
    if not word.isalpha():
        return False
    others = [x.split() for x in before if _BULLET.match(x)]
    if len(others) > 1 and all(x[-1].rstrip(_CLOSERS)[-1:] in tuple(_ENDS) for x in others):
        return True
    return cut and len(others) > 1 and len(words) < min(map(len, others))


def at_limit_by(stop_reason: str | None) -> bool:
    """The stop reason says that the answer met a limit."""
    return (stop_reason or "").strip().lower() in ("length", "max_tokens")


def ends_open(answer: str, stop_reason: str | None, cut_word: bool = False) -> bool:
    """The answer stops before it is complete."""
    text = answer.rstrip()
    if text.count("```") % 2:
        return True
    cut = at_limit_by(stop_reason)
    lines = text.split("\n")
    last = lines[-1].rstrip()
    if _announced_more(text):
        return True
    if last.strip().startswith("```"):
        return False
    if _BARE_ITEM.match(last) and len([x for x in lines if x.strip()]) > 1:
        return True
    if last.count("`") % 2:
        return True
    end = last.rstrip(_CLOSERS) or last
    ch = end[-1]
    if ch in ":：,，、;；([{（-–—/=+&|\\":
        return True
    token = last.split()[-1] if last.split() else last
    if "://" in token:
        return token.rstrip("/").count("/") < 3 and token[-1] not in _ENDS
    if ch in _ENDS:
        # a path cut before its extension
        return bool(re.search(r"(?:^|[\s`(])\w+/[\w/\-]+\.$", end)) and "." not in token[:-1]
    if not (ch.isalnum() or ch == "_"):
        return False
    if last != end and last[-1] in "`\"”’)）」』":
        if not _HAN.search(last):
            return not _BULLET.match(last) and len(last.split()) > 6 and last[-1] == "`"
        return False
    words = end.split()
    if _BULLET.match(last):
        return cut_item(text, cut, cut_word)
    if _ITEM.match(last):
        return True
    if _HAN.search(last):
        return True
    # a short line of its own is a closing phrase or a plain value
    if len(words) <= 4 and len(end) < 28 and words[-1].lower() not in _OPEN_WORDS:
        return cut_word or cut and len(words) > 1
    return True


def _announced_more(text: str) -> bool:
    """A list is announced with more items than follow."""
    lines = [x for x in _BLOCK.sub("", text).split("\n")]
    if not any(_ITEM.match(x) for x in lines):
        return False
    for i, line in enumerate(lines):
        if i + 1 >= len(lines) or _ITEM.match(line):
            continue
        following = [x for x in lines[i + 1 :] if x.strip()]
        if not following or not _ITEM.match(following[0]):
            continue
        said = _SENTENCE.split(line.strip())
        found = list(_NUMBER.finditer(said[-1] or (said[-2] if len(said) > 1 else "")))
        if not found:
            continue
        word = (found[-1].group(1) or found[-1].group(2)).lower()
        n = _NUMBER_WORDS.get(word) or (int(word) if word.isdigit() else 0)
        marks = [int(x) for x in _MARK.findall("\n".join(following))]
        items = sum(bool(_ITEM.match(x)) for x in following)
        if marks:  # numbered: the highest number reached in order, wherever the lines break
            items = 0
            for m in marks:
                items += m == items + 1
        # figures beyond a dozen are measures, unless they stand before a numbered list or a colon
        if n >= 2 and items < n and (n <= 12 or marks or line.rstrip()[-1:] in ":："):
            return True
    return False


def _prose(text: str) -> str:
    """The text without code, addresses, paths and names of code."""
    if "`" in text:
        text = _CODE.sub(" ", text)
    if "/" in text or "_" in text or "::" in text:
        text = "\n".join(" ".join(w for w in line.split(" ") if "/" not in w and "_" not in w and "::" not in w) for line in text.split("\n"))
    return text


_NOT_LATIN = re.compile(r"[^\x00-\u024f\u2000-\u206f]")
_word_votes: dict[str, tuple[tuple[str, float], ...]] = {}


def _votes(words: list[str]) -> dict[str, float]:
    """Votes of the words for the languages whose function words they, or their parts at an apostrophe, are."""
    if len(_word_votes) > 200_000:
        _word_votes.clear()
    votes: dict[str, float] = {}
    for w in words:
        own = _word_votes.get(w)
        if own is None:
            own = _word_votes[w] = tuple((o, 1 / len(owners)) for part in {w, *w.split("'")} if (owners := _OWNERS.get(part)) for o in owners)
        for o, x in own:
            votes[o] = votes.get(o, 0) + x
    return votes


def language_of(text: str) -> dict[str, float]:
    """Letters of the text by language, sentence by sentence, code and names aside.

    A script of its own names the language (kana, hangul, Cyrillic and others);
    Latin letters count for the language whose function words the sentence holds.
    """
    weights: dict[str, float] = {}
    text = _prose(text)
    plain = text.isascii()
    for sentence in _SENTENCE.split(text):
        letters = len(_LETTER.findall(sentence))
        if not letters:
            continue
        if not plain:
            han = len(_HAN.findall(sentence))
            script, n = max(((name, len(p.findall(sentence))) for name, p in _SCRIPTS), key=lambda x: x[1])
            if n * 4 >= letters or n and n * 10 >= han > 0:
                weights[script] = weights.get(script, 0) + (n + han) * 2.5
                continue
            if han * 4 >= letters:
                weights["zh"] = weights.get("zh", 0) + han * 2.5 + (letters - han)
                continue
        votes = _votes(_WORD.findall(sentence.lower()))
        best = max(votes, key=lambda o: votes[o]) if votes else "?"
        weights[best] = weights.get(best, 0) + letters
    return weights


def _main_language(text: str) -> str | None:
    weights = language_of(text)
    known = {k: v for k, v in weights.items() if k != "?"}
    if not known:
        return None
    best = max(known, key=lambda k: known[k])
    return best if known[best] * 2 > sum(weights.values()) else None


def is_other_language(prompt: str, answer: str) -> bool:
    """Mostly in another language than the prompt, which did not ask for it."""
    if not _NOT_LATIN.search(answer) and not _NOT_LATIN.search(prompt):
        # both wholly in one language by all their function words: nothing to weigh
        both = [_votes(_WORD.findall(_prose(x).lower())) for x in (prompt, answer)]
        tops = [max(v, key=lambda o: v[o]) if v else None for v in both]
        if tops[0] and tops[0] == tops[1] and all(v[t] * 10 >= 9 * sum(v.values()) for v, t in zip(both, tops)):
            return False
    said = _main_language(answer)
    if said is None or len(_LETTER.findall(_prose(answer))) < (4 if said == "zh" else 15):
        return False
    asked = _main_language(prompt)
    if asked is None or asked == said:
        return False
    return not any(name == said and pattern.search(prompt) for name, pattern in _ASKED)


def defect(prompt: str, answer: str | None, tool_calls: int, stop_reason: str | None, shortened: bool, at_limit: bool, cut_word: bool = False) -> str | None:
    """The one defect of a pair, or None.

    shortened: another answer continues this one; at_limit: it has a length at
    which answers break off; cut_word: its last word is the beginning of others
    and hardly ever stands inside a line.
    """
    if answer is None or is_empty(answer):
        return None if tool_calls else "empty"
    if is_copy(prompt, answer):
        return "copy"
    if is_refusal(answer):
        return "refusal"
    if ends_open(answer, stop_reason, cut_word):
        return "truncated"
    words = answer.split()
    if shortened and len(words) > 4 and at_limit_by(stop_reason):
        return "truncated"
    if (shortened or at_limit) and answer.rstrip()[-1:].isalnum() and not _BULLET.match(answer.rstrip().split("\n")[-1]) and len(words) > 4:
        return "truncated"
    return "language" if is_other_language(prompt, answer) else None


def shortened_texts(texts: DataFrame) -> DataFrame:
    """(text_hash, size) of each text, of a column `text`, that another one continues.

    Distinct texts are sorted over range partitions; a text is the beginning of
    another one if and only if it is that of its successor, so neighbours suffice.
    """
    ordered = texts.select("text").filter("text is not null and text <> ''").distinct().repartitionByRange("text").sortWithinPartitions("text")

    def neighbours(batches):
        part = TaskContext.get().partitionId()
        before = first = None
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                if before is None:
                    first = text
                elif text.startswith(before):
                    out.append(before)
                before = text
            if out:
                yield rows(out, part, "inner")
        if first is not None:
            yield rows([first], part, "first")
            yield rows([before], part, "last")

    def rows(found, part, place):
        n = len(found)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array([part] * n, pa.int64()), pa.array([place] * n)], names=["text", "part", "place"])

    found = ordered.mapInArrow(neighbours, "text string, part long, place string")
    # the borders: two rows a partition
    edges = found.filter("place <> 'inner'").withColumn("after", F.lead("text").over(Window.orderBy("part", "place")))
    border = edges.filter("place = 'last' and after is not null and after <> text and startswith(after, text)").select("text")
    return found.filter("place = 'inner'").select("text").unionByName(border).select(F.xxhash64("text").alias("text_hash"), F.length("text").alias("size"))


_LINE_WORDS = r"[\p{L}]+(?:['’-][\p{L}]+)*"
#: A word is cut if another one that continues it stands inside lines so many times as often.
CUT_RATIO = 100


def last_words(text) -> Column:
    """The last word of the last line, in lower case, of texts that end in a letter; else null."""
    token = F.element_at(F.split(F.substring_index(F.regexp_replace(text, r"\s+$", ""), "\n", -1), " "), -1)  # a word holds no blank
    return F.lower(F.nullif(F.regexp_extract(token, rf"({_LINE_WORDS})$", 1), F.lit("")))


def cut_words(texts: DataFrame) -> DataFrame:
    """(word) of each closing word, of a column `text`, that is cut.

    The words of all texts are sorted, with the number of times each stands
    inside a line, and a closing word is compared with the neighbours that
    follow it: those that continue it stand next to it. It is cut if one of them
    is CUT_RATIO times as frequent inside lines as itself; the frequencies are
    relative, so one word has one verdict in tables of any size that hold it.
    Words with the same first two letters share a task, where a stack of the
    words that may still be continued is all that is kept. Single letters are
    not judged.
    """
    line = F.explode(F.split(F.lower("text"), "\n"))
    words = F.regexp_extract_all("line", F.lit(f"({_LINE_WORDS})"), F.lit(1))
    inner = texts.select(line.alias("line")).select(F.explode(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))).alias("word"))
    closing = texts.select(last_words(F.col("text")).alias("word")).filter("word is not null")
    counted = inner.groupBy("word").agg(F.count("*").alias("n")).withColumn("closes", F.lit(0)).unionByName(closing.distinct().select("word", F.lit(0).cast("long").alias("n"), F.lit(1).alias("closes")))
    merged = counted.groupBy("word").agg(F.sum("n").alias("n"), F.max("closes").alias("closes")).filter("length(word) > 1")
    ordered = merged.repartition(F.substring("word", 1, 2)).sortWithinPartitions("word")

    def neighbours(batches):
        open_: list[list] = []  # words that begin the current one: word, n, closes, most frequent continuation

        def close(word: str, out: list[str]):
            while open_ and not word.startswith(open_[-1][0]):
                w, n, closes, best = open_.pop()
                if closes and best > n * CUT_RATIO:
                    out.append(w)

        for batch in batches:
            out: list[str] = []
            for word, n, closes in zip(*(batch.column(k).to_pylist() for k in range(3))):
                close(word, out)
                for entry in open_:
                    entry[3] = max(entry[3], n)
                open_.append([word, n, closes, 0])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["word"])
        out = []
        close("\uffff", out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["word"])

    return ordered.select("word", "n", "closes").mapInArrow(neighbours, "word string")


def limit_lengths(answers: DataFrame) -> DataFrame:
    """(size): lengths, of a column `text`, that far more answers without a final mark have than the lengths around."""
    last = F.substring("text", -1, 1)  # of texts without blanks at the end
    open_ = answers.filter(~last.isin(*".!?。！？…`\"'”’)）」』")).groupBy(F.length("text").alias("size")).count()
    w = Window.orderBy("size").rangeBetween(-10, 10)  # as many rows as there are lengths
    around = open_.withColumn("around", (F.sum("count").over(w) - F.col("count")) / 20)
    return around.filter("count >= 8 * (around + 1)").select("size")


def latest_turns(turns: DataFrame) -> DataFrame:
    """(turn_id, prompt, answer, tool_calls, stop_reason): of rows with one turn_id the last received; null ids are left out."""
    m = F.struct(
        F.col("user_message.text").alias("prompt"),
        F.col("llm_message.text").alias("answer"),
        F.coalesce(F.size("llm_message.tool_calls"), F.lit(0)).alias("tool_calls"),
        "stop_reason",
    )
    rows = turns.filter("turn_id is not null").select("turn_id", m.alias("m"), F.struct("received_at", F.xxhash64(m)).alias("at"))
    return rows.groupBy("turn_id").agg(F.max_by("m", "at").alias("m")).select("turn_id", "m.*")


def defective_pairs(turns: DataFrame) -> DataFrame:
    """(turn_id, defect): turns with a prompt whose answer is empty, truncated, a refusal, a copy or in another language.

    A prompt holds a letter or digit; null and blank ones are no cases, nor are
    null turn_ids. A null answer is empty unless the answer calls tools, and so
    is one without letter or digit. Each turn has one defect at most, the first
    of empty, copy, refusal, truncated, language. Repeated rows count once,
    extra columns are ignored, an empty table gives no rows.
    """
    pairs = materialize(latest_turns(turns).filter(F.col("prompt").rlike(r"[\p{L}\p{N}]")), "turns")
    bare = F.regexp_replace("answer", r"\s+$", "")
    texts = pairs.select(bare.alias("text"))
    # few rows, but nothing bounds them; where they are few, the texts need not move
    shortened = broadcast_if_small(shortened_texts(texts).withColumn("shortened", F.lit(True)), "shortened")
    limits = broadcast_if_small(limit_lengths(texts).withColumn("at_limit", F.lit(True)), "limits")
    cut = broadcast_if_small(cut_words(texts.filter("text is not null")).select(F.col("word").alias("last_word"), F.lit(True).alias("cut_word")), "cut_words")
    rows = (
        pairs.withColumn("text_hash", F.xxhash64(bare))
        .withColumn("size", F.length(bare))
        .join(shortened, ["text_hash", "size"], "left")
        .join(limits, "size", "left")
        .withColumn("last_word", last_words(bare))
        .join(cut, "last_word", "left")
        .select(
            "turn_id", "prompt", "answer", "tool_calls", "stop_reason",
            F.coalesce("shortened", F.lit(False)).alias("shortened"),
            F.coalesce("at_limit", F.lit(False)).alias("at_limit"),
            F.coalesce("cut_word", F.lit(False)).alias("cut_word"),
        )
    )

    def judge(batches):
        for batch in batches:
            ids, found = [], []
            for i, pair in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 8)))):
                if verdict := defect(*pair):
                    ids.append(i)
                    found.append(verdict)
            if ids:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array(found)], names=["turn_id", "defect"])

    return rows.mapInArrow(judge, f"turn_id {dict(turns.dtypes)['turn_id']}, defect string")
