"""Near-duplicate texts by a grouped prefix join over several token orders.

A text is the set of its runs of n letters and digits. Under a random order of
all runs, two sets of similarity s begin alike with about probability s; their
first runs under r orders are all alike with about s^r. Those r first runs are a
prefix of the set: texts with identical prefixes fall into one group, and the
join takes L prefixes, each under orders of its own. Texts with identical sets
are collapsed before into one representative, the pairs of a group are filtered
by size and by a sketch, and what is left is verified on the whole sets.

Small sets leave some of the groups that the runs are dealt into without a
common run, which blocks many prefixes at once. For them there is an exact join:
of each set the first |s| - t|s| + 1 runs, rarest first; two sets of similarity
t share one of these. Its pairs are filtered by bounds that no such pair breaks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, discard, materialize, release

_GROUPS = 8
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _Letters:
    """Which code points are letters or digits, filled in as they are met."""

    def __init__(self):
        self.known = np.zeros(0x110000, bool)
        self.keeps = np.zeros(0x110000, bool)
        self.known[:128] = True
        self.keeps[:128] = [chr(i).isalnum() for i in range(128)]

    def of(self, points: np.ndarray) -> np.ndarray:
        if not (known := self.known[points]).all():
            for p in np.unique(points[~known]).tolist():
                self.known[p], self.keeps[p] = True, chr(p).isalnum()
        return self.keeps[points]


_letters: list[_Letters] = []


def kept_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of the lower-cased texts as one array of code points, and the texts' edges in it."""
    if not _letters:
        _letters.append(_Letters())
    texts = [t.lower() for t in texts]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    keep = _letters[0].of(points)
    return points[keep], np.concatenate([[0], np.cumsum(keep)])[edges]


def run_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of the run of n code points that begins at each position."""
    x = points.astype(np.uint64)
    size = max(0, len(x) - n + 1)
    h = np.zeros(size, np.uint64)
    for k in range(n):
        h = (h << np.uint64(21)) ^ (h >> np.uint64(43)) ^ x[k : k + size]
        if (k + 1) % 3 == 0 or k == n - 1:  # three code points of 21 bits fit before they must be mixed
            h = h * _MULTIPLIER
            h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


#: Bits of a run's hash that are kept; the others number the texts of a batch while it is sorted.
_HASH_BITS = 52
_BATCH = 1 << (64 - _HASH_BITS)
_HASH_MASK = np.uint64((1 << _HASH_BITS) - 1)


class RunSets:
    """The sorted sets of run hashes of up to 4,096 texts, one after the other in `flat`; empty where a text has fewer than `least` letters and digits."""

    def __init__(self, texts: list[str], n: int, least: int):
        points, edges = kept_points(texts)
        hashes = run_hashes(points, n) >> np.uint64(64 - _HASH_BITS)
        sizes = np.diff(edges)
        count = np.where(sizes >= max(least, n), sizes - n + 1, 0)
        owner = np.repeat(np.arange(len(texts)), count)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        keys = hashes[edges[:-1][owner] + within] | owner.astype(np.uint64) << np.uint64(_HASH_BITS)
        keys.sort()
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
        self.owner = (keys >> np.uint64(_HASH_BITS)).astype(np.int64)
        self.flat = keys & _HASH_MASK
        self.count = np.bincount(self.owner, minlength=len(texts))
        self.start = np.cumsum(self.count) - self.count


class PrefixOrders:
    """The first runs of a set under many random orders, in `bands` prefixes of `rows` runs.

    The runs are dealt by hash into 8 groups with orders of their own, so that a
    set is passed once for bands x rows / 8 orders; a prefix takes its runs
    from different groups.
    """

    def __init__(self, bands: int, rows: int, seed: int = 11):
        if rows > _GROUPS:
            raise ValueError(f"a prefix has at most {_GROUPS} runs")
        self.bands, self.rows = bands, rows
        self.orders = -(-bands * rows // _GROUPS)
        rng = np.random.default_rng(seed)
        self.factor = rng.integers(1, 2**32, self.orders, dtype=np.uint32) | np.uint32(1)
        self.shift = rng.integers(0, 2**32, self.orders, dtype=np.uint32)
        # band b takes row r from group (b + r) % 8; every value of a group is used once
        used = [0] * _GROUPS
        picks = np.zeros((bands, rows), np.int64)
        for b in range(bands):
            for r in range(rows):
                g = (b * rows + r) % _GROUPS
                picks[b, r] = g * self.orders + used[g]
                used[g] += 1
        self.picks = picks

    def first_runs(self, flat: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        """For each text a row of the least values under each order of each group; all ones where a group is empty."""
        out = np.full((texts * _GROUPS, self.orders), 0xFFFFFFFF, np.uint32)
        segment = owner * _GROUPS + (flat >> np.uint64(_HASH_BITS - 3)).astype(np.int64)
        x = (flat >> np.uint64(8)).astype(np.uint32)
        begin = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if len(x) else np.zeros(0, np.int64)
        edge = np.append(begin, len(x))
        at = 0
        while at < len(begin):  # as many whole segments as stay within the cache
            to = max(at + 1, int(np.searchsorted(edge, edge[at] + 6000, "right")) - 1)
            y = x[edge[at] : edge[to], None] * self.factor
            y ^= y >> np.uint32(15)
            y += self.shift
            y *= np.uint32(0x2C1B3C6D)
            y ^= y >> np.uint32(13)
            out[segment[begin[at:to]]] = np.minimum.reduceat(y, edge[at:to] - edge[at], axis=0)
            at = to
        return out.reshape(texts, -1)

    def prefixes(self, firsts: np.ndarray) -> np.ndarray:
        """A 64-bit key of each prefix of each row of first runs."""
        key = np.zeros((len(firsts), self.bands), np.uint64)
        for r in range(self.rows):
            key = (key ^ firsts[:, self.picks[:, r]]) * _MULTIPLIER
            key ^= key >> np.uint64(31)
        return key * np.uint64(0x94D049BB133111EB) + np.arange(self.bands, dtype=np.uint64)[None, :] * _MULTIPLIER


_SKETCH_BITS = 256
_PARITY_BITS = 128
_MARKS = ("mark0", "mark1", "mark2", "mark3")
#: Members of a group up to which its pairs are made where it is gathered.
_AT_ONCE = 64
#: Prefix keys that one task groups.
_BUCKET_KEYS = 250_000


def sketch(firsts: np.ndarray) -> np.ndarray:
    """Rows of four 64-bit numbers: one bit of each of 256 first runs spread over the groups."""
    at = np.arange(_SKETCH_BITS) * firsts.shape[1] // _SKETCH_BITS
    bits = np.ascontiguousarray(firsts[:, at] & np.uint32(1)).astype(bool)
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.int64)


#: Buckets in which runs are counted for the order of the exact join.
_COUNTED = 1 << 16


def run_counts(source: DataFrame, run: int, least: int) -> np.ndarray:
    """How many sets hold a run of each bucket of run hashes."""

    def count(batches):
        total = np.zeros(_COUNTED, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                flat = RunSets(batch.column(1).slice(at, 500).to_pylist(), run, least).flat
                total += np.bincount((flat & np.uint64(_COUNTED - 1)).astype(np.int64), minlength=_COUNTED)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["bucket", "n"])

    out = np.zeros(_COUNTED, np.int64)
    for r in source.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def rare_runs(sets: RunSets, counts: np.ndarray, threshold: float) -> list[bytes]:
    """Of each set the runs of which it shares one with every set of that similarity, rarest first."""
    order = np.lexsort((sets.flat, counts[(sets.flat & np.uint64(_COUNTED - 1)).astype(np.int64)], sets.owner))
    flat = sets.flat[order]
    length = sets.count - np.ceil(sets.count * threshold - 1e-9).astype(np.int64) + 1
    return [flat[a : a + n].tobytes() for a, n in zip(sets.start.tolist(), length.tolist())]


def parity_marks(sets: RunSets) -> np.ndarray:
    """Rows of four 64-bit numbers, the last two 0: of each of 128 bits whether an odd number of the set's runs fall on it."""
    at = ((sets.flat * _MULTIPLIER) >> np.uint64(57)).astype(np.int64)
    odd = np.bincount(sets.owner * _PARITY_BITS + at, minlength=len(sets.count) * _PARITY_BITS) & 1
    marks = np.packbits(odd.reshape(-1, _PARITY_BITS).astype(bool), axis=1).view(np.int64)
    return np.concatenate([marks, np.zeros_like(marks)], axis=1)


_ENTRY = np.dtype([("key", np.uint64), ("name", np.int64), ("mark0", np.uint64), ("mark1", np.uint64), ("size", np.int32), ("place", np.int32)])


def _could_be_similar(left: np.ndarray, right: np.ndarray, threshold: float, within: bool) -> np.ndarray:
    """(2, n): names of the pairs of entries of one key that size, place and marks allow; no similar pair is left out.

    Sets of sizes a and b reach the threshold with t (a + b) / (1 + t) common
    runs. They have at most as many as there are before and after the two places
    of the key, and differ in at least as many runs as their marks in bits.
    """
    out = []
    step = max(1, 200_000 // len(right))
    for at in range(0, len(left), step):
        u, v = left[at : at + step, None], right[None, at if within else 0 :]
        a, b = u["size"], v["size"]
        both = a + b
        need = np.ceil(both * (threshold / (1 + threshold)) - 1e-9).astype(np.int32)
        differ = np.bitwise_count(u["mark0"] ^ v["mark0"]) + np.bitwise_count(u["mark1"] ^ v["mark1"])
        keep = differ.astype(np.int32) <= both - 2 * need
        i, j = np.nonzero(keep)
        if not len(i):
            continue
        x, y, least = u[i, 0], v[0, j], need[i, j]
        shared = np.minimum(x["place"], y["place"]) + 1 + np.minimum(x["size"] - x["place"], y["size"] - y["place"]) - 1
        keep = (shared >= least) & (x["name"] != y["name"]) & (np.minimum(x["size"], y["size"]) >= np.maximum(x["size"], y["size"]) * threshold - 1e-9)
        if within:
            keep &= j > i
        x, y = x["name"][keep], y["name"][keep]
        out.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
    return np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((2, 0), np.int64)


def _exact_pairs(signed: DataFrame, buckets: int, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(a, b), all pairs of sets that share one of their rare runs and could be similar, and the written table they are read from."""

    def deal(batches):
        """Packs the entries into one array for each bucket, equal sets once."""
        held: dict[int, tuple] = {}
        size = 0
        for batch in batches:
            for same, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if same not in held:
                    held[same] = rest
                    size += len(rest[3]) // 8
                if size > 500_000:
                    yield flush(held)
                    held, size = {}, 0
        if held:
            yield flush(held)

    def flush(held):
        sizes, mark0, mark1, keys = zip(*held.values())
        n = np.array([len(k) // 8 for k in keys])
        rows = np.zeros(n.sum(), _ENTRY)
        rows["key"] = np.frombuffer(b"".join(keys), np.uint64)
        for name, values in (("name", list(held)), ("mark0", np.array(mark0, np.int64).view(np.uint64)), ("mark1", np.array(mark1, np.int64).view(np.uint64)), ("size", sizes)):
            rows[name] = np.repeat(np.array(values, _ENTRY[name]), n)
        rows["place"] = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        bucket = ((rows["key"] * _MULTIPLIER >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rows, edges = rows[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
        full = [b for b in range(buckets) if edges[b] < edges[b + 1]]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([rows[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary())], names=["bucket", "entries"])

    def pair_up(batches):
        """Pairs within the keys; entries of keys with more than `block` are handed on in blocks."""
        parts = [e for batch in batches for e in batch.column(1).to_pylist()]
        if not parts:
            return
        rows = np.frombuffer(b"".join(parts), _ENTRY)
        rows = rows[np.lexsort((rows["name"], rows["key"]))]
        key, name = rows["key"], rows["name"]
        rows = rows[np.concatenate([[True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])])]
        key = rows["key"]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(begin, len(key)))
        pairs = []
        for at, n in zip(begin[size > 1].tolist(), size[size > 1].tolist()):
            group = rows[at : at + n]
            if n > block:
                cut = [group[k : k + block].tobytes() for k in range(0, n, block)]
                for i, e in enumerate(cut):
                    yield handed(int(key[at : at + 1].view(np.int64)[0]), i, len(cut), e)
                continue
            pairs.append(_could_be_similar(group, group, threshold, True))
            if len(pairs) > 2000:
                yield found(pairs)
                pairs = []
        if pairs:
            yield found(pairs)

    def found(pairs):
        a, b = np.unique(np.concatenate(pairs, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.nulls(len(a), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=_HANDED)

    def handed(key, own, blocks, entries):
        return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *(pa.array([x], pa.int64()) for x in (key, own, blocks)), pa.array([entries], pa.binary())], names=_HANDED)

    def compare(batches):
        for batch in batches:
            for left, right, same in zip(*(c.to_pylist() for c in batch.columns)):
                u, v = np.frombuffer(left, _ENTRY), np.frombuffer(right, _ENTRY)
                a, b = _could_be_similar(u, v, threshold, same)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = signed.select("same", "size", "mark0", "mark1", "keys").mapInArrow(deal, "bucket long, entries binary")
    met = materialize(dealt.repartition(buckets, "bucket").mapInArrow(pair_up, "a long, b long, key long, own long, blocks long, entries binary"), "pairs")
    pairs = met.filter("a is not null").select("a", "b")
    large = met.filter("key is not null").select("key", "own", "entries")
    if not large.isEmpty():
        right = large.select("key", F.col("own").alias("other"), F.col("entries").alias("right"))
        tasks = large.join(right, "key").filter("own <= other").select(F.col("entries").alias("left"), "right", (F.col("own") == F.col("other")).alias("same"))
        pairs = pairs.unionByName(tasks.repartition(buckets).mapInArrow(compare, "a long, b long"))
    return pairs, met


_HANDED = ["a", "b", "key", "own", "blocks", "entries"]


def _text_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null")


def similar_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    *,
    run: int,
    least: int,
    threshold: float = 0.6,
    bands: int = 64,
    rows: int = 5,
    block: int = 2000,
    exact: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Near-duplicate texts: (links, members).

    links (a, b, similarity): pairs of representatives, a < b, whose sets of
    runs of `run` letters and digits have a Jaccard similarity of at least
    `threshold`. members (id, representative): every id of a text of at least
    `least` letters and digits, with the least id among those of the same set;
    an id with several texts has several rows.

    With `exact`, for sets of few runs such as titles, no pair is missed; the
    work grows with the number of sets that share a rare run. Otherwise a pair
    of similarity s is missed with probability about (1 - s^rows)^bands if its
    sets have some 100 runs or more: at 0.6 six in a thousand by the defaults,
    at 0.67 one in ten thousand. Smaller sets are missed more often, as their
    first runs come from 8 groups that all prefixes share: of sets of 40 runs
    four in a hundred at 0.6, one in a hundred at 0.67. What is found is
    verified on the whole sets. Null ids, null texts and texts too
    short have no rows. Every prefix key goes to one of a number of buckets that
    grows with the input, packed in arrays; groups of more than 64
    representatives are dealt into blocks of `block`, and every two blocks are
    compared in a task of their own, which keeps the pairs whose sizes and
    sketches allow the similarity.
    """
    spark = df.sparkSession
    orders = PrefixOrders(bands, rows)
    source = _text_rows(df, id_col, text_col)
    counts = run_counts(source, run, least) if exact else None

    def signatures(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = RunSets(part.column(1).to_pylist(), run, least)
                there = np.flatnonzero(sets.count)
                if not len(there):
                    continue
                with np.errstate(over="ignore"):
                    same = np.add.reduceat(sets.flat * _MULTIPLIER, sets.start[there]) ^ sets.count[there].astype(np.uint64) * _MULTIPLIER
                    if exact:
                        marks, keys = parity_marks(sets)[there], rare_runs(sets, counts, threshold)
                        keys = [keys[t] for t in there]
                    else:
                        firsts = orders.first_runs(sets.flat, sets.owner, part.num_rows)[there]
                        marks, keys = sketch(firsts), [k.tobytes() for k in orders.prefixes(firsts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(there)),
                        pa.array(same.view(np.int64)),
                        pa.array(sets.count[there], pa.int32()),
                        *(pa.array(marks[:, m]) for m in range(len(_MARKS))),
                        pa.array(keys, pa.binary()),
                    ],
                    names=["id", "same", "size", *_MARKS, "keys"],
                )

    signed = materialize(source.mapInArrow(signatures, f"id string, same long, size int, {' long, '.join(_MARKS)} long, keys binary"), "signatures")
    # identical sets are one representative, whatever the number of copies
    marks = materialize(
        signed.groupBy("same").agg(
            F.min("id").alias("representative"), F.max("size").alias("size"), *(F.max(m).alias(m) for m in _MARKS)
        ),
        "marks",
    )
    members = signed.select("id", "same").join(marks.select("same", "representative"), "same").select("id", "representative").distinct()
    buckets = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), signed.count() * bands // _BUCKET_KEYS)

    def deal(batches):
        """Packs (prefix key, set) pairs into one array for each bucket, equal sets once."""
        held: dict[int, bytes] = {}
        for batch in batches:
            held.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            if len(held) * bands > 1_000_000:
                yield flush(held)
                held = {}
        if held:
            yield flush(held)

    def flush(held):
        keys = np.frombuffer(b"".join(held.values()), np.uint64)
        names = np.repeat(np.fromiter(held, np.int64, len(held)), bands)
        bucket = ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        # within a bucket half of a key tells groups apart but for a few pairs in billions, which the filters remove
        keys, names = keys[order].astype(np.uint32), names[order]
        full = [b for b in range(buckets) if edges[b] < edges[b + 1]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(full, pa.int64()),
                pa.array([keys[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()),
                pa.array([names[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()),
            ],
            names=["bucket", "keys", "names"],
        )

    dealt = signed.select("same", "keys").mapInArrow(deal, "bucket long, keys binary, names binary")

    def pair_up(batches):
        """Pairs within the groups of equal prefixes; members of large groups are handed on."""
        keys, names = [], []
        for batch in batches:
            for bucket, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(np.frombuffer(part, np.uint32).astype(np.uint64) | np.uint64(bucket << 32))
            names += batch.column(2).to_pylist()
        if not keys:
            return
        key, name = np.concatenate(keys), np.frombuffer(b"".join(names), np.int64)
        order = np.lexsort((name, key))
        key, name = key[order], name[order]
        once = np.concatenate([[True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])])
        key, name = key[once], name[once]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(begin, len(key)))
        pairs, waiting = [], 0
        for at, n in zip(begin[size > 1].tolist(), size[size > 1].tolist()):
            if n > min(block, _AT_ONCE):
                yield _pairs(name[at : at + n], np.full(n, int(key[at : at + 1].view(np.int64)[0])), True)
                continue
            i, j = np.triu_indices(n, 1) if n > 2 else (np.array([0]), np.array([1]))
            pairs.append(np.stack([name[at + i], name[at + j]]))
            waiting += len(i)
            if waiting > 200_000:
                both = np.unique(np.concatenate(pairs, axis=1), axis=1)
                yield _pairs(both[0], both[1], False)
                pairs, waiting = [], 0
        if pairs:
            both = np.unique(np.concatenate(pairs, axis=1), axis=1)
            yield _pairs(both[0], both[1], False)

    def _pairs(a, b, large):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), large))], names=["a", "b", "large"])

    if exact:
        pairs, found = _exact_pairs(signed, buckets, threshold, block)
    else:
        found = materialize(dealt.repartition(buckets, "bucket").select("bucket", "keys", "names").mapInArrow(pair_up, "a long, b long, large boolean"), "pairs")
        release(spark)
        pairs = found.filter("not large").select("a", "b")
        large = found.filter("large").select(F.col("a").alias("same"), F.col("b").alias("key"))
        if not large.isEmpty():
            pairs = pairs.unionByName(_block_pairs(large.join(marks, "same"), block, threshold))
    # size and sketch filter
    side = lambda x: marks.select(F.col("same").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("representative", "size", *_MARKS)))
    differ = sum((F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))) for m in _MARKS), F.lit(0))
    checked = (
        pairs.distinct()
        .join(side("a"), "a")
        .join(side("b"), "b")
        .filter(F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * F.lit(threshold) - F.lit(1e-9))
        .filter(F.lit(exact) | (differ <= F.lit(_SKETCH_BITS - _least_agreement(threshold))))
        .select("a", "b", "representative_a", "representative_b")
    )
    candidates = materialize(checked, "candidates")
    release(spark)
    links, texts = _verify(candidates, source, run, least, threshold)
    links = materialize(links, "links")
    discard(found, candidates, texts)
    return links, members


def _least_agreement(threshold: float) -> int:
    """Bits of 256 in which sets of that similarity agree but for one pair in 100,000, less three for what the groups of small sets vary."""
    p = (1 + threshold) / 2
    return int(_SKETCH_BITS * p - 4.3 * (_SKETCH_BITS * p * (1 - p)) ** 0.5) - 3


def _block_pairs(large: DataFrame, block: int, threshold: float) -> DataFrame:
    """Pairs of the members of large groups that their sizes and sketches allow: members dealt into blocks, and every two blocks compared in a task.

    large: (key, same, size, marks). Only what the filter of all pairs would keep leaves the task.
    """
    counts = large.groupBy("key").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    placed = large.join(counts, "key").withColumn("own", F.pmod(F.xxhash64("same"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = placed.withColumn("other", other).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "same", "size", *_MARKS
    )
    most = _SKETCH_BITS - _least_agreement(threshold)

    def compare(table: pa.Table) -> pa.Table:
        own, same, size, *marks = (table.column(c).to_numpy() for c in ("own", "same", "size", *_MARKS))
        marks = [m.view(np.uint64) for m in marks]  # bits of a negative number are those of its absolute value
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = (np.flatnonzero(own == x)[np.unique(same[own == x], return_index=True)[1]] for x in (i, j))
        found = []
        for at in range(0, len(left), step := max(1, 500_000 // max(1, len(right)))):
            u, v = left[at : at + step, None], right[None]
            keep = np.minimum(size[u], size[v]) >= np.maximum(size[u], size[v]) * threshold - 1e-9
            keep &= sum(np.bitwise_count(m[u] ^ m[v]).astype(np.int32) for m in marks) <= most
            keep &= same[u] < same[v] if i == j else same[u] != same[v]
            x, y = np.nonzero(keep)
            found.append(np.stack([same[u[x, 0]], same[v[0, y]]]))
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return spread.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def _verify(candidates: DataFrame, source: DataFrame, run: int, least: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The candidates whose whole sets reach the threshold, and the written texts; texts travel only for representatives that have a candidate.

    A representative's id may have several texts; the pair counts by the most similar two.
    """
    # where few texts are wanted, the others need not move
    wanted = broadcast_if_small(candidates.select(F.explode(F.array("representative_a", "representative_b")).alias("id")).distinct(), "wanted")
    texts = materialize(source.join(wanted, "id").groupBy("id").agg(F.collect_set("text").alias("texts")), "texts")
    side = lambda x: texts.select(F.col("id").alias(f"representative_{x}"), F.col("texts").alias(f"texts_{x}"))
    paired = candidates.join(side("a"), "representative_a").join(side("b"), "representative_b")

    def verify(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [
                    (i, u, v)
                    for i, (us, vs) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist()))
                    for u in us
                    for v in vs
                ]
                for k in range(0, len(rows), 1000):
                    yield from check(part, rows[k : k + 1000])

    def check(part, rows):
        number = {t: n for n, t in enumerate(dict.fromkeys(t for _, u, v in rows for t in (u, v)))}
        names = list(number)
        sets = RunSets(names, run, least)
        best: dict[int, float] = {}
        for i, u, v in rows:
            s, t = (sets.flat[sets.start[n] : sets.start[n] + sets.count[n]] for n in (number[u], number[v]))
            both = np.concatenate([s, t])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            if len(both) and len(s) and len(t):
                best[i] = max(best.get(i, 0.0), common / (len(both) - common))
        found = [(i, j) for i, j in best.items() if j >= threshold]
        if found:
            a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
            out = [(min(a[i], b[i]), max(a[i], b[i]), j) for i, j in found]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["a", "b", "similarity"])

    found = paired.select("representative_a", "representative_b", "texts_a", "texts_b").mapInArrow(verify, "a string, b string, similarity double")
    return found.groupBy("a", "b").agg(F.max("similarity").alias("similarity")).filter("a <> b"), texts


def expand_links(links: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of ids, of linked representatives and of one representative."""
    named = members.select(F.col("representative").alias("r"), "id")
    across = (
        links.select("a", "b")
        .join(named.select(F.col("r").alias("a"), F.col("id").alias("x")), "a")
        .join(named.select(F.col("r").alias("b"), F.col("id").alias("y")), "b")
    )
    copies = named.filter("r <> id").select("r").distinct()
    copied = named.join(copies, "r", "left_semi")
    within = copied.select("r", F.col("id").alias("x")).join(copied.select("r", F.col("id").alias("y")), "r").filter("x < y")
    pairs = across.select("x", "y").unionByName(within.select("x", "y")).filter("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
