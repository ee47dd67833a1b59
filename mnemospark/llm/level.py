"""Reading level of English prose: gradient-boosted regression trees over word, length, syntax and cohesion figures."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairs import _FUNCTION_WORDS

_LATINATE = ("tion", "sion", "ity", "ance", "ence", "ment", "ism", "ency", "ancy", "ness", "ical", "ional", "able", "ible", "ive", "ous", "ate", "ize", "izes", "ates", "ual")
_ENGLISH_ENDINGS = ("tion", "tions", "ity", "ing", "ed", "ly", "ness", "ment", "izes", "able", "ance", "ence")
_SUBORDINATES = set(
    "that which who whom whose whence whereby wherein whereas whatever whoever although though unless until because since while if when where as lest save nor once than whether".split()
)
_PLAIN_WORDS = set("it is you can do not we i ask me if and the a an to in on at by for this your my then now here next too first".split())
_PUNCTUATION = "\"'“”‘’„«»()[]{}<>.,;:!?…*#>|~-–—•=+_"

# per word, summed over a text and divided by its words
_WORD_FIGURES = ("letters", "long7", "long10", "long13", "latinate", "subordinate", "plain", "the", "of", "odds1", "odds3")
FIGURES = (*_WORD_FIGURES, "spread", "words_log", "sentence", "sentence_spread", "commas", "semicolons", "distinct", "repeats", "overlap")
#: More sentences or windows than a text has.
_WIDE = 1 << 32
_ENGLISH = set(_FUNCTION_WORDS["en"])
_FOREIGN = {w for k in ("de", "fr", "es") for w in _FUNCTION_WORDS[k]} - _ENGLISH


def _plain_token(token: str) -> str | None:
    """The word a token holds, in lower case; None for names of code, paths, numbers and marks."""
    w = token.strip(_PUNCTUATION).lower().replace("’", "'")
    if len(w) > 2 and w.endswith("'s"):
        w = w[:-2]
    return w if w and w.replace("'", "").replace("-", "").isalpha() and "::" not in w and w.count("-") < 2 else None


class Lexicon:
    """Words of the labelled samples: how much likelier each is in plain and in demanding than in other samples."""

    def __init__(self, texts: list[str], grades: list[int]):
        by = {g: Counter() for g in (1, 2, 3)}
        for text, grade in zip(texts, grades):
            by[min(3, max(1, grade))].update({w for t in prose(text).split() if (w := _plain_token(t))})
        n = {g: max(1, sum(1 for x in grades if x == g)) for g in by}
        self.words = set().union(*by.values())
        self.odds1, self.odds3 = {}, {}
        for w in self.words:
            share = {g: (by[g][w] + 0.5) / (n[g] + 1) for g in by}
            self.odds1[w] = float(np.clip(np.log(share[1] / max(share[2], share[3])), -3, 3))
            self.odds3[w] = float(np.clip(np.log(share[3] / max(share[1], share[2])), -3, 3))


def prose(text: str) -> str:
    """The text without code blocks; one that is not closed is no block."""
    if "```" in text:
        parts = text.split("```")
        text = "\n".join(parts[::2] if len(parts) % 2 else [*parts[:-1:2], parts[-1]])
    return text


class Figures:
    """Figures of texts, with the tokens met so far."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self._forget()

    def _forget(self):
        self.known: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.rows = np.zeros((1024, len(_WORD_FIGURES)))
        self.word = np.full(1024, -1, np.int64)  # of a token; -1: no word
        self.flags = np.zeros((1024, 7), bool)  # ends a sentence, comma, semicolon, English, foreign, Han, a name of code

    def _learn(self, token: str) -> int:
        if token in self.known:
            return self.known[token]
        i = self.known[token] = len(self.known)
        if i == len(self.word):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.word = np.concatenate([self.word, np.full_like(self.word, -1)])
            self.flags = np.concatenate([self.flags, np.zeros_like(self.flags)])
        bare = token.rstrip("\"'”’)*_`")
        w = _plain_token(token) if "`" not in token else None
        self.flags[i, :3] = bare[-1:] in (".", "!", "?"), bare[-1:] == ",", bare[-1:] in (";", ":")
        self.flags[i, 5] = any("㐀" <= c <= "鿿" for c in token)
        if w is None or self.flags[i, 5]:
            self.flags[i, 6] = not self.flags[i, 5] and any(map(str.isalpha, token))
            return i
        self.word[i] = self.words.setdefault(w, len(self.words))
        lex, n = self.lexicon, len(w)
        self.rows[i] = (
            n, n >= 7, n >= 10, n >= 13, n >= 6 and w.endswith(_LATINATE), w in _SUBORDINATES, w in _PLAIN_WORDS,
            w == "the", w == "of", lex.odds1.get(w, 0.0), lex.odds3.get(w, 0.0),
        )
        self.flags[i, 3] = w in _ENGLISH or w in lex.words or (n > 5 and w.isascii() and w.endswith(_ENGLISH_ENDINGS))
        self.flags[i, 4] = w in _FOREIGN and w not in lex.words or not w.isascii()
        return i

    def of(self, text: str) -> tuple[int, int, float, float, np.ndarray]:
        """(words and names, words, share of English ones, share of foreign ones and Han, figures)."""
        if len(self.known) >= 400_000:
            self._forget()
        breaks, tokens = [], []
        for line in prose(text).split("\n"):
            if part := line.split():
                tokens += part
                breaks.append(len(tokens))
        ids = list(map(self.known.get, tokens))
        if None in ids:
            ids = [self._learn(t) if i is None else i for t, i in zip(tokens, ids)]
        ids = np.array(ids, np.int64)
        word = self.word[ids]
        is_word = word >= 0
        n = int(is_word.sum())
        flags = self.flags[ids]
        marks = flags.sum(0)
        outsiders = int(marks[5])
        if not n:
            return 0, 0, 0.0, float(outsiders > 0), np.zeros(len(FIGURES))
        w = word[is_word]
        rows = self.rows[ids[is_word]]
        ends = flags[:, 0]
        ends[np.array(breaks) - 1] = True
        at = np.cumsum(is_word)[ends]
        sizes = np.diff(at, prepend=0)
        sizes = sizes[sizes > 0]
        # distinct words within windows of 50, which do not depend on the text's length
        local = len(np.unique(w * _WIDE + np.arange(n) // 50)) / n
        # words of a sentence that the next one takes up
        pairs = np.unique(w * _WIDE + np.repeat(np.arange(len(sizes)), sizes))
        seen = 1 + int((np.diff(pairs // _WIDE) != 0).sum())
        overlap = float((np.diff(pairs) == 1).sum()) / len(pairs)
        figures = np.array([
            *rows.mean(0), rows[:, 0].std(), np.log(n), np.log1p(sizes.mean()), np.log1p(sizes.std()), marks[1] / n, marks[2] / n,
            local, seen / n**0.7, overlap,
        ])
        return n + int(marks[6]), n, marks[3] / n, (marks[4] + outsiders) / (n + outsiders), figures


class BoostedTrees:
    """Squared-loss gradient boosting of regression trees, with shrinkage and row sampling by a fixed seed."""

    def __init__(self, rounds: int = 120, depth: int = 3, rate: float = 0.1, least: int = 5, rows: float = 0.8, seed: int = 5):
        self.rounds, self.depth, self.rate, self.least, self.rows, self.seed = rounds, depth, rate, least, rows, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        rng = np.random.default_rng(self.seed)
        self.base = float(y.mean())
        self.trees = []
        at = np.full(len(y), self.base)
        for _ in range(self.rounds):
            chosen = np.sort(rng.choice(len(y), max(1, int(len(y) * self.rows)), replace=False))
            tree = self._grow(x[chosen], (y - at)[chosen], self.depth)
            self.trees.append(tree)
            at += self.rate * self._walk(tree, x)
        return self

    def _grow(self, x, r, depth):
        if not depth or len(r) < 2 * self.least:
            return float(r.mean())
        best = (1e-9, None, None)
        total, n = r.sum(), len(r)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, c = x[order, f], np.cumsum(r[order])
            k = np.arange(1, n)
            gain = c[:-1] ** 2 / k + (total - c[:-1]) ** 2 / (n - k) - total**2 / n
            gain[(v[1:] == v[:-1]) | (k < self.least) | (n - k < self.least)] = 0
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], f, (v[i] + v[i + 1]) / 2)
        if best[1] is None:
            return float(r.mean())
        left = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[left], r[left], depth - 1), self._grow(x[~left], r[~left], depth - 1)

    def _walk(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        left = x[:, tree[0]] <= tree[1]
        out = np.empty(len(x))
        out[left], out[~left] = self._walk(tree[2], x[left]), self._walk(tree[3], x[~left])
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += self.rate * self._walk(tree, x)
        return out


class LevelModel:
    """Grades of texts, fitted on labelled samples and calibrated on predictions for held-out folds.

    With `sources` all samples of one source are held out together, so that the
    cuts and the accuracy are those of sources not seen. The accuracy of a fold
    is that of cuts chosen on the other folds; the model's own cuts use all.
    """

    def __init__(self, texts: list[str], grades: list[int], sources: list[str] | None = None, folds: int = 5):
        y = np.array(grades, float)
        fold = np.arange(len(y)) % folds
        if sources is not None:
            number = {s: i for i, (s, _) in enumerate(Counter(sources).most_common())}
            if len(number) < 2:
                raise ValueError("folds by source need two sources at least")
            folds = min(folds, len(number))
            fold = np.array([number[s] % folds for s in sources])
        lexicon = Lexicon(texts, grades)
        x = np.zeros((len(y), len(FIGURES)))
        # word odds from the other folds, so that no sample is described by its own label
        for k in range(folds):
            out = fold == k
            figures = Figures(Lexicon([t for t, o in zip(texts, out) if not o], [g for g, o in zip(grades, out) if not o]))
            x[out] = [figures.of(t)[4] for t, o in zip(texts, out) if o]
        held = np.zeros(len(y))
        for k in range(folds):
            out = fold == k
            held[out] = BoostedTrees().fit(x[~out], y[~out]).predict(x[out])
        right = np.zeros(len(y), bool)
        for k in range(folds):
            out = fold == k
            self.cuts = [self._cut(held[~out], y[~out], g) for g in (1, 2)]
            right[out] = self._grade(held[out]) == y[out]
        self.held_out_accuracy = float(right.mean())
        self.cuts = [self._cut(held, y, g) for g in (1, 2)]
        self.trees = BoostedTrees().fit(x, y)
        self.figures = Figures(lexicon)

    @staticmethod
    def _cut(score: np.ndarray, y: np.ndarray, below: int) -> float:
        """The middle of the best cut between the grades up to `below` and those above."""
        tries = np.linspace(below + 0.1, below + 0.9, 81)
        right = [((score > c) == (y > below)).mean() for c in tries]
        best = tries[np.isclose(right, max(right))]
        return float(best[len(best) // 2])

    def _grade(self, score: np.ndarray) -> np.ndarray:
        return 1 + (score > self.cuts[0]) + (score > self.cuts[1])

    def grades(self, texts: list[str], least_words: int) -> tuple[list[int], np.ndarray]:
        """Positions of the English prose texts of at least so many words, and their scores."""
        at, rows = [], []
        for i, text in enumerate(texts):
            said, words, english, foreign, figures = self.figures.of(text)
            if said >= least_words and words * 2 >= least_words and english >= 0.4 and foreign <= min(0.25, english / 2):
                at.append(i)
                rows.append(figures)
        return at, self.trees.predict(np.array(rows)) if rows else np.zeros(0)


def train_level_model(samples: DataFrame, text_col: str = "sample_text", grade_col: str = "grade", max_samples: int = 5000, source_col: str | None = None) -> LevelModel:
    """The model of at most `max_samples` labelled rows with text and grade, in order of text hash, validated by source where the samples have one.

    The bound keeps training on the driver small; a labelled set larger than it
    is cut by text hash.
    """
    rows = samples.select(text_col, grade_col, *([F.coalesce(source_col, F.lit(""))] if source_col else [])).filter(F.col(text_col).isNotNull() & F.col(grade_col).isNotNull())
    rows = rows.orderBy(F.xxhash64(text_col), text_col).limit(max_samples).collect()
    if len(rows) < 10:
        raise ValueError("a level model needs at least ten labelled samples")
    return LevelModel([r[0] for r in rows], [int(r[1]) for r in rows], [r[2] for r in rows] if source_col else None)


def reading_levels(df: DataFrame, id_col: str, text_col: str, model: LevelModel, least_words: int = 40) -> DataFrame:
    """(id, grade bigint, score double) of each English prose text of at least `least_words` words.

    Code blocks and numbers do not count as words, and names of code and paths
    must not be more than half of them. Null,
    empty and short texts, code and texts in other languages have no row;
    repeated rows are repeated. One pass without a shuffle, over whole texts.
    """

    def grade(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                at, score = model.grades(part.column(1).to_pylist(), least_words)
                if at:
                    grades = model._grade(score).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(grades), pa.array(score)], names=[id_col, "grade", "score"])

    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col), text.alias("__text")).filter(F.length("__text") >= 2 * least_words)
    return rows.mapInArrow(grade, f"`{id_col}` {dict(df.dtypes)[id_col]}, grade long, score double")
