"""Filling containers of fixed capacity with items of varying length."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from . import bpe


class OpenWindows:
    """A fixed number of open containers; an item goes into the fullest that still holds it.

    When none holds it and all windows are in use, the fullest is closed and
    handed out. Items stay in the window until it is closed, so memory is
    bounded by windows times capacity.
    """

    def __init__(self, capacity: int, windows: int, name: int):
        self.capacity, self.windows, self.next = capacity, windows, name
        self.left: list[tuple[int, int]] = []  # (room left, container), in order
        self.items: dict[int, list] = {}

    def place(self, size: int, item) -> list:
        """Puts the item somewhere; the closed window's [(container, item)], if one had to be closed."""
        closed: list = []
        i = bisect_left(self.left, (size, -1))
        if i < len(self.left):
            room, box = self.left.pop(i)
        else:
            if len(self.left) == self.windows:
                closed = self._close(self.left.pop(0)[1])
            room, box = self.capacity, self.next
            self.next += 1
            self.items[box] = []
        self.items[box].append(item)
        if room == size:
            closed = closed + self._close(box)
        else:
            insort(self.left, (room - size, box))
        return closed

    def _close(self, box: int) -> list:
        return [(box, item) for item in self.items.pop(box)]

    def rest(self) -> list:
        return [(box, item) for _, box in self.left for item in self.items[box]]


_ZERO_ITEMS = 4096


def _place_all(entries, capacity: int, windows: int):
    """Lists of (container, item, is still open) for (size, item) entries of one partition."""
    packer = OpenWindows(capacity, windows, TaskContext.get().partitionId() << 40)
    empty = 0
    for size, item in entries:
        if size == 0:  # takes no room: apart, so that no window holds an unbounded number of items
            yield [((TaskContext.get().partitionId() << 40) + (1 << 39) + empty // _ZERO_ITEMS, item, False)]
            empty += 1
        elif out := packer.place(size, item):
            yield [(box, x, False) for box, x in out]
    yield [(box, x, True) for box, x in packer.rest()]


def pack_documents(
    df: DataFrame, id_col: str, text_col: str, capacity: int = 2048, windows: int = 64, ranks_path: str | None = None
) -> DataFrame:
    """(id, piece int, first_token bigint, tokens bigint, container bigint): every text laid into containers.

    Texts are sized in tokens of the tokenizer. A text is placed whole unless it
    alone exceeds the capacity; then it is cut into pieces of `capacity` tokens
    and a rest. Each partition of the input packs what it reads into `windows`
    open containers, best fit first, closing the fullest when none fits. The
    containers left open at the ends, at most `windows` a partition, are merged
    in rounds, each packing the open ones of 16 partitions as items again. Only
    those leftovers are shuffled.

    Null and empty texts are items of 0 tokens, gathered in containers of
    their own (4,096 a container); repeated rows are items of their own; extra
    columns are left behind; an empty table gives no rows.
    """
    id_type = df.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField(id_col, id_type),
            T.StructField("piece", T.IntegerType()),
            T.StructField("first_token", T.LongType()),
            T.StructField("tokens", T.LongType()),
            T.StructField("__box", T.LongType()),
            T.StructField("__open", T.BooleanType()),
        ]
    )

    def first_round(batches):
        codec = bpe.load(ranks_path)
        kind = []

        def entries():
            for batch in batches:
                kind[:] = [batch.column(0).type]
                for name, size in zip(batch.column(0).to_pylist(), codec.counts(batch.column(1)).tolist()):
                    for piece, at in enumerate(range(0, max(size, 1), capacity)):
                        n = min(capacity, size - at)
                        yield n, (name, piece, at, n)

        rows: list = []
        for placed in _place_all(entries(), capacity, windows):
            rows += placed
            if len(rows) > 20_000:
                yield batch_of(rows, kind[0])
                rows = []
        if rows:
            yield batch_of(rows, kind[0])

    def batch_of(rows, kind):
        columns = list(zip(*[(*item, box, is_open) for box, item, is_open in rows]))
        types = [kind, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.fieldNames())

    source = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    placed = materialize(source.mapInArrow(first_round, schema), "packed")
    # every round knows its partitions by the numbers of the containers
    partitions = placed.agg(F.max(F.shiftright("__box", 40)).alias("p")).first()["p"]
    left = placed.filter("__open").groupBy(F.col("__box").alias("box")).agg(F.sum("tokens").alias("size"))
    moves = []
    round_ = 1
    while partitions is not None:
        parts = (partitions + 16) // 16
        merged = materialize(_merge_round(left, parts, capacity, windows, round_), f"merged{round_}")
        moves.append(merged)
        if parts == 1:
            break
        left = merged.filter("open").groupBy(F.col("new").alias("box")).agg(F.sum("size").alias("size"))
        partitions = parts - 1
        round_ += 1
    out = placed
    container = F.col("__box")
    for n, move in enumerate(moves):
        out = out.withColumn("__at", container).join(
            move.select(F.col("box").alias("__at"), F.col("new").alias(f"__new{n}")), "__at", "left"
        )
        container = F.coalesce(F.col(f"__new{n}"), F.col("__at"))
    return out.select(id_col, "piece", "first_token", "tokens", container.alias("container"))


def _merge_round(left: DataFrame, parts: int, capacity: int, windows: int, round_: int) -> DataFrame:
    """(box, size, new, open): leftover containers packed as items, the largest first."""
    schema = "box long, size long, new long, open boolean"

    def merge(batches):
        def entries():
            for batch in batches:
                yield from zip(batch.column(1).to_pylist(), zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))

        for placed in _place_all(entries(), capacity, windows):
            if placed:
                box, size, new, is_open = zip(*[(b, s, (round_ << 56) + n, o) for n, (b, s), o in placed])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(box, pa.int64()), pa.array(size, pa.int64()), pa.array(new, pa.int64()), pa.array(is_open, pa.bool_())],
                    names=["box", "size", "new", "open"],
                )

    return (
        left.repartition(parts, "box").sortWithinPartitions(F.col("size").desc(), "box").select("box", "size").mapInArrow(merge, schema)
    )


def container_fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row (containers, tokens, fill): the share of the containers' room that holds tokens, empty ones aside."""
    boxes = packed.groupBy("container").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")
    return boxes.agg(
        F.count("*").alias("containers"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        (F.sum("tokens") / (F.count("*") * F.lit(capacity))).alias("fill"),
    )
