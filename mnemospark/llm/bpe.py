"""Byte-pair encoding of Arrow text columns by whole numpy arrays.

Texts are cut into words at the public byte-level pattern, the distinct words
of a batch are merged together in length-bucketed, padded matrices (every row
merges its leftmost pair of the lowest rank each round, pairs being looked up
in a hash table), and the words' ids are laid back over the texts. No Python
loop runs per text or per token.

Null and empty texts encode to an empty list.
"""

from __future__ import annotations

import base64
import heapq
import os

import numpy as np
import pyarrow as pa
import regex

TOKENIZER_DIR = os.environ.get("MNEMOSPARK_TOKENIZERS", "/opt/tokenizers")
DEFAULT_RANKS = "byte_bpe_50k.tiktoken"

_LETTER, _NUMBER, _SPACE, _OTHER, _UNKNOWN = 1, 2, 3, 4, 0
_CHUNK_CHARS = 3_000_000


class CharClasses:
    """Class of every code point, filled in as code points are met."""

    def __init__(self):
        self.table = np.zeros(0x110000, np.uint8)
        self._letter, self._number, self._space = (regex.compile(p) for p in (r"\p{L}", r"\p{N}", r"\s"))

    def of(self, points: np.ndarray) -> np.ndarray:
        found = self.table[points]
        if (found == _UNKNOWN).any():
            for p in np.unique(points[found == _UNKNOWN]).tolist():
                self.table[p] = self._class(p)
            found = self.table[points]
        return found

    def _class(self, p: int) -> int:
        if 0xD800 <= p <= 0xDFFF:
            return _OTHER
        c = chr(p)
        if self._letter.match(c):
            return _LETTER
        if self._number.match(c):
            return _NUMBER
        # the four separators U+001C..1F are white space to Python only
        return _SPACE if self._space.match(c) and not 0x1C <= p <= 0x1F else _OTHER


def split_words(points: np.ndarray, starts: np.ndarray, classes: CharClasses) -> np.ndarray:
    """Sorted positions in `points` where a word begins; `starts` are the first positions of non-empty texts.

    Equal to the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    cls = classes.of(points)
    first = np.zeros(n, bool)
    first[starts] = True
    run = np.empty(n, bool)
    run[0] = True
    np.not_equal(cls[1:], cls[:-1], out=run[1:])
    run |= first
    at = np.flatnonzero(run)
    kind = cls[at]
    end = np.append(at[1:], n)
    closes = np.append(first[at[1:]], True)  # the run ends its text
    begins = np.zeros(n + 1, bool)
    # runs of white space: all but the last character, which stands alone or, as a blank, leads the next word
    space = kind == _SPACE
    s_at, s_end, s_last = at[space], end[space], closes[space]
    begins[s_at] = True
    inner = ~s_last
    begins[s_end[inner] - 1] = True
    # other runs begin a word unless a blank leads it
    w_at = at[~space]
    led = np.zeros(len(w_at), bool)
    has_before = (w_at > 0) & ~first[w_at]
    led[has_before] = points[w_at[has_before] - 1] == 0x20
    begins[w_at[~led]] = True
    # contractions
    word_kind, word_end, word_closes = kind[~space], end[~space], closes[~space]
    quote = (word_kind == _OTHER) & (points[w_at] == 0x27) & (word_end - w_at == 1) & ~led & ~word_closes
    q = w_at[quote]
    q = q[cls[np.minimum(q + 1, n - 1)] == _LETTER]
    if len(q):
        one = points[q + 1]
        follows = np.minimum(q + 2, n - 1)
        two = np.where((q + 2 < n) & ~first[follows], points[follows], 0)
        size = np.zeros(len(q), np.int64)
        size[np.isin(one, [0x73, 0x74, 0x6D, 0x64])] = 1
        pair = ((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
        size[pair] = 2
        q, size = q[size > 0], size[size > 0]
        begins[q + 1] = False
        nxt = q + 1 + size
        inside = nxt < n
        nxt = nxt[inside]
        begins[nxt[(cls[nxt] == _LETTER) & ~first[nxt]]] = True
    return np.flatnonzero(begins[:n])


class PairTable:
    """Merged id of a pair of ids, by open addressing over numpy arrays."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        size = 1 << int(np.ceil(np.log2(max(16, 4 * len(left)))))
        self.mask = np.uint64(size - 1)
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, self.NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]] = keys[free]  # of several that meet, the last one written holds the slot
            won = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[won]] = merged[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & int(self.mask)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        x = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x >> np.uint64(32)) & self.mask).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(keys.ravel())
        flat = keys.ravel()
        out = np.full(len(flat), self.NONE, np.int32)
        todo = np.arange(len(flat))
        for _ in range(self.probes):
            held = self.keys[slot[todo]]
            hit = held == flat[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (held != -1)]
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & int(self.mask)
        return out.reshape(keys.shape)


class ByteBpe:
    """A byte-level BPE vocabulary in the rank-file format, with the words met so far."""

    MAX_WORDS = 300_000
    #: Bytes of a word from which a heap takes the place of a matrix row.
    LONG = 512

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pairs = [
            (self.ranks[token[:i]], self.ranks[token[i:]], rank)
            for token, rank in self.ranks.items()
            if len(token) > 1
            for i in range(1, len(token))
            if token[:i] in self.ranks and token[i:] in self.ranks
        ]
        left, right, merged = (np.array(x, np.int32) for x in zip(*pairs))
        self.pairs = PairTable(left, right, merged)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.classes = CharClasses()
        self._forget()

    def _forget(self):
        self.known: dict[bytes, int] = {}
        self.offset = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.store = np.zeros(0, np.int32)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        out: list[np.ndarray | None] = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(sizes > self.LONG).tolist():
            out[i] = self._merge_long(words[i])
        bucket = np.ceil(np.log2(np.maximum(sizes, 2))).astype(int)
        for b in np.unique(bucket).tolist():
            rows_of_bucket = np.flatnonzero((bucket == b) & (sizes <= self.LONG))
            for k in range(0, len(rows_of_bucket), step := max(1, 2_000_000 >> b)):
                self._merge_bucket([words[i] for i in rows_of_bucket[k : k + step]], rows_of_bucket[k : k + step], out)
        return out

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The same merges by a heap over linked ids, where a padded row would take quadratic time."""
        ids = self.byte[np.frombuffer(word, np.uint8)]
        ranks = self.pairs.get(ids[:-1], ids[1:]).tolist()
        ids = ids.tolist()
        n, none = len(ids), int(PairTable.NONE)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, r in enumerate(ranks) if r != none]
        heapq.heapify(heap)
        ranks.append(none)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or ranks[i] != r:
                continue
            j = after[i]
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a < 0 or b >= n:
                    if a >= 0:
                        ranks[a] = none
                    continue
                ranks[a] = s = self._pair(ids[a], ids[b])
                if s != none:
                    heapq.heappush(heap, (s, a))
        return np.array([x for x in ids if x >= 0], np.int32)

    def _pair(self, a: int, b: int) -> int:
        return self.ranks.get(self.token[a] + self.token[b], int(PairTable.NONE))

    def _merge_bucket(self, words: list[bytes], names: np.ndarray, out: list):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max())
        ids = np.full((len(words), width), -1, np.int32)
        ids[np.arange(width)[None, :] < sizes[:, None]] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        ranks = self._pair_ranks(ids)
        while True:
            if ids.shape[1] < 2:
                done = np.ones(len(ids), bool)
            else:
                where = ranks.argmin(axis=1)
                done = ranks[np.arange(len(ids)), where] == PairTable.NONE
            for name, row in zip(names[done].tolist(), ids[done]):
                out[name] = row[row >= 0]
            if done.all():
                return
            live = ~done
            ids, ranks, names, where = ids[live], ranks[live], names[live], where[live]
            r = np.arange(len(ids))
            ids[r, where] = ranks[r, where]
            keep = np.ones(ids.shape, bool)
            keep[r, where + 1] = False
            ids = ids[keep].reshape(len(ids), -1)
            if ids.shape[1] < 2:
                ranks = np.zeros((len(ids), 0), np.int32)
                continue
            keep = np.ones(ranks.shape, bool)
            keep[r, np.minimum(where + 1, ranks.shape[1] - 1)] = False
            ranks = ranks[keep].reshape(len(ids), -1)
            for shift in (-1, 0):  # only the two pairs beside the merge change
                at = where + shift
                ok = (at >= 0) & (at < ranks.shape[1])
                a, b = ids[r[ok], at[ok]], ids[r[ok], at[ok] + 1]
                ranks[r[ok], at[ok]] = np.where((a < 0) | (b < 0), PairTable.NONE, self.pairs.get(a, b))

    def _pair_ranks(self, ids: np.ndarray) -> np.ndarray:
        a, b = ids[:, :-1], ids[:, 1:]
        return np.where((a < 0) | (b < 0), PairTable.NONE, self.pairs.get(a, b))

    def _learn(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words in the store."""
        if len(self.known) > self.MAX_WORDS:
            self._forget()
        known = self.known
        fresh = [w for w in words if w not in known]
        if fresh:
            whole = [self.ranks.get(w, -1) for w in fresh]
            hard = [w for w, r in zip(fresh, whole) if r < 0]
            merged = iter(self.merge(hard)) if hard else iter(())
            ids = [np.array([r], np.int32) if r >= 0 else next(merged) for r in whole]
            length = np.fromiter(map(len, ids), np.int64, len(ids))
            base = len(self.store)
            for i, w in enumerate(fresh, len(known)):
                known[w] = i
            self.store = np.concatenate([self.store, *ids])
            self.offset = np.concatenate([self.offset, base + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
        return np.fromiter((known[w] for w in words), np.int64, len(words))

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per word its number in the store; per text its first word's position, and the end."""
        whole = "".join(texts)
        raw = whole.encode("utf-8", "surrogatepass")
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        edges = np.concatenate([[0], np.cumsum(sizes)])
        if not whole:
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = split_words(points, np.unique(edges[:-1][sizes > 0]), self.classes)
        if len(raw) == len(points):
            at = begins
        else:
            wide = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
            at = np.concatenate([[0], np.cumsum(wide, dtype=np.int64)])[begins]
        offsets = np.append(at, len(raw)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        coded = words.dictionary_encode()
        numbers = self._learn(coded.dictionary.to_pylist())
        return numbers[coded.indices.to_numpy(zero_copy_only=False)], np.searchsorted(begins, edges)

    def _chunks(self, column: pa.Array):
        texts = [x or "" for x in column.to_pylist()]
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= _CHUNK_CHARS):
                chars += len(texts[end])
                end += 1
            yield texts[at:end]
            at = end

    def counts(self, column: pa.Array) -> np.ndarray:
        """Number of tokens of each text."""
        out = []
        for texts in self._chunks(column):
            words, edges = self._words(texts)
            total = np.concatenate([[0], np.cumsum(self.length[words])]) if len(words) else np.zeros(1, np.int64)
            out.append(np.diff(total[edges]))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def encode(self, column: pa.Array) -> pa.ListArray:
        """Ids of each text, never null."""
        ids, sizes = [], []
        for texts in self._chunks(column):
            words, edges = self._words(texts)
            length = self.length[words]
            total = np.concatenate([[0], np.cumsum(length)])
            within = np.arange(total[-1]) - np.repeat(total[:-1], length)
            ids.append(self.store[np.repeat(self.offset[words], length) + within])
            sizes.append(np.diff(total[edges]))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


_loaded: dict[str, ByteBpe] = {}


def load(path: str | None = None) -> ByteBpe:
    """The vocabulary at `path`, read once per Python worker."""
    path = path or os.path.join(TOKENIZER_DIR, DEFAULT_RANKS)
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]
