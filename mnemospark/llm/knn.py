"""The most similar vectors of every vector, by stable projections and a kd-tree.

Vectors of length one are projected onto a few random Gaussian directions. The
squared projected distance of two vectors, divided by their squared distance,
follows a chi-square distribution, so a query may stop once the remaining
projected distances exceed what that distribution allows, at the wanted
probability, for a vector as near as the k-th found so far. Projections are
indexed by a kd-tree whose leaves are the units of distribution: a query first
visits its own leaf, then the leaves its stopping radius reaches. Within a leaf
its projected neighbours are verified in order of their distance, a few at a
time, until the next one lies beyond what the test allows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def chi_square_quantile(p: float, m: int) -> float:
    """The value a chi-square variable of m degrees of freedom stays below with probability p."""

    def below(x: float) -> float:  # regularised lower incomplete gamma function, by its series
        a, x = m / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))

    low, high = 1e-9, 10.0 * m + 100
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def sound_vectors(df: DataFrame, id_col: str, vector_col: str, time_col: str | None, dim: int) -> DataFrame:
    """(id, unit array<float>): the latest vector of each id, if it has `dim` finite values that are not all zero.

    Null ids are left out; equal times are decided by the larger vector; exact
    duplicates merge. An id whose latest vector is unsound gives no row.
    """
    rows = df.filter(F.col(id_col).isNotNull())
    value = F.col(vector_col).cast("array<float>")
    at = F.struct(*([F.col(time_col)] if time_col else []), value)
    latest = rows.groupBy(F.col(id_col).alias("id")).agg(F.max_by(F.struct(value.alias("v")), at).alias("m")).select("id", F.col("m.v").alias("v"))

    def normalise(batches):
        for batch in batches:
            size = pa.compute.equal(pa.compute.list_value_length(batch.column(1)), dim).fill_null(False)
            part = batch.filter(size)
            if not part.num_rows:
                continue
            # null entries become NaN, and no square of a float overflows a double
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            norm = np.sqrt((x * x).sum(1))
            sound = np.isfinite(norm) & (norm > 0)
            unit = (x[sound] / norm[sound, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(sound)), _lists(unit)], names=["id", "unit"])

    return latest.mapInArrow(normalise, f"id {dict(latest.dtypes)['id']}, unit array<float>")


class KdTree:
    """Splits of a bounded sample of projected points; leaf and leaf boxes of any point."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, m = depth, sample.shape[1]
        inner = (1 << depth) - 1
        self.axis, self.value = np.zeros(inner, np.int64), np.zeros(inner)
        leaves = 1 << depth
        self.low, self.high = np.full((leaves, m), -np.inf), np.full((leaves, m), np.inf)
        self._build(0, sample, np.full(m, -np.inf), np.full(m, np.inf), depth)

    def _build(self, node: int, points: np.ndarray, low: np.ndarray, high: np.ndarray, left: int):
        if not left:
            leaf = node - ((1 << self.depth) - 1)
            self.low[leaf], self.high[leaf] = low, high
            return
        axis = int(np.ptp(points, axis=0).argmax()) if len(points) else 0
        value = float(np.median(points[:, axis])) if len(points) else 0.0
        self.axis[node], self.value[node] = axis, value
        below = points[:, axis] <= value
        h, lo = high.copy(), low.copy()
        h[axis], lo[axis] = min(h[axis], value), max(lo[axis], value)
        self._build(2 * node + 1, points[below], low, h, left - 1)
        self._build(2 * node + 2, points[~below], lo, high, left - 1)

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.value[node])
        return node - ((1 << self.depth) - 1)

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point from each leaf's box."""
        out = np.zeros((len(points), 1 << self.depth))
        for a in range(points.shape[1]):
            low, high = self.low[:, a], self.high[:, a]
            gap = np.maximum(np.maximum(low[None] - points[:, a : a + 1], points[:, a : a + 1] - high[None]), 0)
            out += gap * gap
        return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel()))


def nearest_vectors(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = 5,
    *,
    dim: int = 64,
    min_cosine: float | None = None,
    directions: int = 12,
    probability: float = 0.99,
    leaf_rows: int = 16_384,
    sample_rows: int = 20_000,
    seed: int = 7,
) -> DataFrame:
    """(query, neighbour, cosine double): up to k other ids of the highest cosine for each query.

    `vectors` and `queries` as from sound_vectors (queries: a semi-joinable
    subset by id, default all). With min_cosine only neighbours at least that
    similar are found, which bounds the stopping radius. The tree is fitted on
    at most `sample_rows` vectors chosen by hash; every vector is indexed, and
    its splits, the only thing shipped to all tasks, are bounded by that sample.
    `probability` is that of the chi-square test, for each true neighbour a
    lower bound of its chance to be found. Equal cosines are decided by the
    smaller id. An empty table gives no rows.

    Vectors travel once to their own leaf. A query travels to the leaves that
    its radius reaches: the radius shrinks with the k-th neighbour in its own
    leaf. A leaf that a third of all vectors share (equal vectors cannot be
    split) is cut into blocks of at most 4 x `leaf_rows`; where more than twice
    that many queries ask a block, they are cut into pieces too, and the block's
    vectors travel to each. Within a block the projected distances of a tile of
    queries and vectors are one product of matrices; what lies within the radius
    is verified nearest first. There are 8 leaves at least, and as many as the
    sample's size allows at most (2,048), beyond which leaves consist of blocks.
    """
    spark = vectors.sparkSession
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((dim, directions)).astype(np.float32)
    base = materialize(vectors.select("id", "unit"), "vectors")
    total = base.count()
    if not total:
        kind = dict(base.dtypes)["id"]
        return spark.createDataFrame([], f"query {kind}, neighbour {kind}, cosine double")
    share = min(1.0, sample_rows / total)
    sample = base.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("unit").limit(sample_rows)
    points = np.array([r["unit"] for r in sample.collect()], np.float32).reshape(-1, dim) @ planes
    depth = min(int(math.log2(sample_rows)) - 3, max(3, math.ceil(math.log2(total / leaf_rows))))
    tree = KdTree(points.astype(np.float64), depth)
    id_type = dict(base.dtypes)["id"]
    limit = chi_square_quantile(probability, directions)
    widest = math.inf if min_cosine is None else 2 * (1 - min_cosine)

    def to_leaf(batches):
        for batch in batches:
            projected = _matrix(batch.column(1), dim) @ planes
            leaf = tree.leaf(projected.astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf, pa.int64())], names=["id", "unit", "leaf"])

    placed = base.select("id", "unit").mapInArrow(to_leaf, f"id {id_type}, unit array<float>, leaf long")
    # leaves too full for one task are cut into blocks; their queries visit each block
    sizes = placed.groupBy("leaf").count().collect()  # at most 2^depth rows
    blocks = np.ones(1 << depth, np.int64)
    for r in sizes:
        blocks[r["leaf"]] = max(1, math.ceil(r["count"] / (4 * leaf_rows)))
    start = np.concatenate([[0], np.cumsum(blocks)])

    def to_block(batches):
        for batch in batches:
            leaf = batch.column(2).to_numpy()
            salt = pa.compute.cast(batch.column(3), pa.int64()).to_numpy()
            block = start[leaf] + salt % blocks[leaf]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(block, pa.int64())], names=["id", "unit", "block"])

    salted = placed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("long"))
    stored = materialize(salted.mapInArrow(to_block, f"id {id_type}, unit array<float>, block long"), "leaves")
    asked = stored if queries is None else stored.join(queries.select("id").distinct(), "id", "left_semi")
    parts = int(start[-1])
    piece_rows = 2 * leaf_rows

    def visit(asking: DataFrame, asked_of: np.ndarray) -> DataFrame:
        """asking: (id, unit, block, radius), asked_of: their number by block; the k best of each query in each block it visits."""
        pieces = np.maximum(1, -(-asked_of // piece_rows))
        own = F.element_at(F.array(*(F.lit(int(n)) for n in pieces)), (F.col("block") + 1).cast("int"))
        everywhere = F.explode(F.sequence(F.lit(0), own - 1)).alias("piece")
        rows = stored.select("block", everywhere, F.lit(0).alias("asks"), "id", "unit", F.lit(0.0).alias("radius")).unionByName(
            asking.select("block", F.pmod(F.xxhash64("id"), own).cast("int").alias("piece"), F.lit(1).alias("asks"), "id", "unit", "radius")
        )

        def search(batches):
            here, ids, held = None, [], []
            for batch in batches:
                block, asks = batch.column(0).to_numpy() * (1 << 20) + batch.column(1).to_numpy(), batch.column(2).to_numpy()
                edges = np.concatenate([[0], np.flatnonzero((np.diff(block) != 0) | (np.diff(asks) != 0)) + 1, [len(block)]])
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    part = batch.slice(a, b - a)
                    unit = _matrix(part.column(4), dim)
                    if not asks[a]:
                        if block[a] != here:
                            here, ids, held = block[a], [], []
                        ids += part.column(3).to_pylist()
                        held.append(unit)
                    elif block[a] == here:
                        if isinstance(held, list):
                            held, ids = np.concatenate(held), np.array(ids, object)
                            far = held @ planes
                            far = np.concatenate([far, (far * far).sum(1, keepdims=True), np.ones((len(far), 1), np.float32)], axis=1)
                        yield from compare(np.array(part.column(3).to_pylist(), object), unit, part.column(5).to_numpy(), ids, held, far)

        def cosines(unit, i, held, j):
            out = np.empty(len(i), np.float64)
            for s in range(0, len(i), 100_000):
                out[s : s + 100_000] = np.einsum("ij,ij->i", unit[i[s : s + 100_000]], held[j[s : s + 100_000]], dtype=np.float64)
            return out

        def compare(names, unit, radius, ids, held, far):
            near = unit @ planes
            near = np.concatenate([-2 * near, np.ones((len(near), 1), np.float32), (near * near).sum(1, keepdims=True)], axis=1)
            for a in range(0, len(names), 128):
                q, u, r = near[a : a + 128], unit[a : a + 128], radius[a : a + 128]
                name = names[a : a + 128]
                if min_cosine is None:  # the nearest by projection bound the radius of queries that have none yet
                    r = first_bound(q, u, r, name, ids, held, far)
                allowed = (r * 1.0001 + 1e-5).astype(np.float32)[:, None]
                found = []
                for b in range(0, len(far), 4096):
                    gap = q @ far[b : b + 4096].T
                    at = np.flatnonzero(gap <= allowed)
                    i, j = np.divmod(at, gap.shape[1])
                    found.append((i, j + b, gap.ravel()[at]))
                i, j, gap = (np.concatenate(x) for x in zip(*found))
                if len(i) > len(q) * len(far) / 50 and len(far) > k + 1:  # so many that one product of matrices costs less than the pairs one by one
                    i, j, gap = promising(i, j, gap, u, held)
                if len(i):
                    yield from verified(i, j, gap, u, name, ids, held)

        def promising(i, j, gap, u, held):
            """Of the candidates those that single precision puts among the k + 1 best of their query, or near them."""
            cosine = np.full((len(u), len(held)), -3.0, np.float32)
            cosine[i, j] = (u @ held.T)[i, j]
            least = np.partition(cosine, -k - 1, axis=1)[:, -k - 1] - np.float32(1e-5)
            keep = cosine[i, j] >= least[i]
            return i[keep], j[keep], gap[keep]

        def first_bound(q, u, r, name, ids, held, far):
            m = min(4 * k + 1, len(far))
            gap = q @ far.T
            j = np.argpartition(gap, m - 1, axis=1)[:, :m] if m < len(far) else np.tile(np.arange(len(far)), (len(q), 1))
            i = np.repeat(np.arange(len(q)), m)
            cosine = np.where(name[i] == ids[j.ravel()], -2.0, cosines(u, i, held, j.ravel())).reshape(len(q), m)
            kth = np.sort(cosine, axis=1)[:, -k] if m > k else np.full(len(q), -1.0)
            return np.minimum(r, np.where(kth > -1, limit * 2 * (1 - kth) + 1e-6, r))

        def verified(i, j, gap, u, name, ids, held):
            """Verifies candidates in order of projected distance, in rounds of 16, 48, 144 ... a query, until the test stops it."""
            order = np.lexsort((gap, i))
            i, j, gap = i[order], j[order], gap[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            cosine = np.full(len(i), -3.0)
            kth = np.full(len(name), -1.0 if min_cosine is None else min_cosine)
            low, high = 0, 16
            while True:
                now = np.flatnonzero((place >= low) & (place < high) & (gap <= limit * 2 * (1 - kth[i]) * 1.0001 + 1e-5))
                if len(now):
                    c = cosines(u, i[now], held, j[now])
                    c[name[i[now]] == ids[j[now]]] = -3.0
                    cosine[now] = c
                if high > place.max():
                    break
                done = np.flatnonzero(cosine >= (-1.5 if min_cosine is None else min_cosine))
                best = done[np.lexsort((-cosine[done], i[done]))]
                at = np.arange(len(best)) - np.searchsorted(i[best], i[best])
                ends = best[at == k - 1]
                kth[i[ends]] = np.maximum(kth[i[ends]], cosine[ends])
                low, high = high, high * 3
            keep = cosine >= (-1.5 if min_cosine is None else min_cosine - 1e-6)
            i, j, cosine = i[keep], j[keep], cosine[keep]
            order = np.lexsort((-cosine, i))
            i, j, cosine = i[order], j[order], cosine[order]
            # k, and all that tie with the last, so that ids can decide
            first = np.searchsorted(i, i)
            last = cosine[np.minimum(first + k - 1, np.searchsorted(i, i, "right") - 1)]
            keep = cosine >= last - 1e-9
            i, j, cosine = i[keep], j[keep], cosine[keep]
            if len(i):
                kind = pa.string() if id_type == "string" else None
                yield pa.RecordBatch.from_arrays([pa.array(name[i].tolist(), kind), pa.array(ids[j].tolist(), kind), pa.array(cosine)], names=["query", "neighbour", "cosine"])

        # more partitions than pieces, so that few meet in one
        tasks = rows.repartition(4 * int(pieces.sum()), "block", "piece").sortWithinPartitions("block", "piece", "asks")
        return tasks.select("block", "piece", "asks", "id", "unit", "radius").mapInArrow(search, f"query {id_type}, neighbour {id_type}, cosine double")

    def best(found: DataFrame) -> DataFrame:
        top = found.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "neighbour"))), 1, k).alias("top"))
        return top.select("query", F.inline("top")).select("query", "neighbour", (-F.col("far")).alias("cosine"))

    asked_of = np.zeros(parts, np.int64)
    for r in asked.groupBy("block").count().collect():  # a row a block
        asked_of[r["block"]] = r["count"]
    first = materialize(best(visit(asked.withColumn("radius", F.lit(limit * min(widest, 4.0))), asked_of)), "own")
    kth = first.groupBy("query").agg(F.count("*").alias("n"), F.min("cosine").alias("c")).select(F.col("query").alias("id"), F.when(F.col("n") >= k, F.col("c")).alias("c"))
    reach = F.least(F.lit(widest), F.coalesce(2 * (1 - F.col("c")), F.lit(4.0)))
    asking = asked.join(kth, "id", "left").select("id", "unit", "block", (reach * F.lit(limit) + F.lit(1e-6)).alias("radius"))
    owner = np.repeat(np.arange(len(blocks)), blocks)

    def reached(part):
        """(row, block) of the blocks that each row's radius reaches, but its own."""
        projected = (_matrix(part.column(1), dim) @ planes).astype(np.float64)
        near = (tree.distances(projected) <= part.column(3).to_numpy()[:, None])[:, owner]
        near[np.arange(part.num_rows), part.column(2).to_numpy()] = False
        return np.nonzero(near)

    def count_reached(batches):
        total = np.zeros(parts, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                total += np.bincount(reached(batch.slice(at, 2000))[1], minlength=parts)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["block", "n"])

    def to_reached(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                i, block = reached(part)
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(block, pa.int64()), part.column(3).take(take)],
                    names=["id", "unit", "block", "radius"],
                )

    asked_of = np.zeros(parts, np.int64)
    for r in asking.mapInArrow(count_reached, "block long, n long").groupBy("block").agg(F.sum("n").alias("n")).collect():  # a row a block
        asked_of[r["block"]] = r["n"]
    rest = asking.mapInArrow(to_reached, f"id {id_type}, unit array<float>, block long, radius double")
    return best(first.unionByName(visit(rest, asked_of)))


def similar_pairs(neighbours: DataFrame, min_cosine: float) -> DataFrame:
    """(a, b, cosine), a < b: pairs at least so similar of which one is among the neighbours of the other."""
    rows = neighbours.filter(F.col("cosine") >= min_cosine)
    return rows.groupBy(F.least("query", "neighbour").alias("a"), F.greatest("query", "neighbour").alias("b")).agg(F.max("cosine").alias("cosine"))
