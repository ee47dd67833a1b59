"""Cutting oversized texts at natural boundaries, with overlap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Token estimate in quarter tokens a character: 0.25, and 1.25 more in the CJK ranges.
_PLAIN, _CJK = 1, 6
_CJK_RANGES = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x3040, 0x309F), (0x30A0, 0x30FF), (0xAC00, 0xD7AF))
_WHITE = np.array([i for i in range(0x3001) if chr(i).isspace()], np.uint32)


def quarter_tokens(points: np.ndarray) -> np.ndarray:
    """Prefix sums, from 0, of the characters' estimates in quarter tokens."""
    cost = np.full(len(points), _PLAIN, np.int64)
    if len(points) and points.max() >= 0x3040:
        for low, high in _CJK_RANGES:
            cost[(points >= low) & (points <= high)] = _CJK
    return np.concatenate([[0], np.cumsum(cost)])


def natural_boundaries(points: np.ndarray) -> np.ndarray:
    """Sorted offsets: start, end, after a line feed, after . ! ? before white space, after the full-width marks."""
    n = len(points)
    ends = points == 0x0A
    stop = np.flatnonzero((points[:-1] == 0x2E) | (points[:-1] == 0x21) | (points[:-1] == 0x3F)) if n else np.zeros(0, int)
    ends[stop[np.isin(points[stop + 1], _WHITE)]] = True
    ends |= (points == 0x3002) | (points == 0xFF01) | (points == 0xFF1F)
    return np.unique(np.concatenate([[0], np.flatnonzero(ends) + 1, [n]]))


def cut(prefix: np.ndarray, bounds: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, bool]]:
    """(start, end, hard) of each piece; limit and overlap in the unit of `prefix`.

    A piece ends at the last boundary it can reach within the limit, if that
    lies beyond the piece before it and leaves the piece longer than the
    overlap, and else as far as the limit goes. The next starts as far back from
    there as the overlap allows: later than this one, so that no piece is
    repeated whole.
    """
    n = len(prefix) - 1
    pieces: list[tuple[int, int, bool]] = []
    start = end = 0
    while end < n:
        reach = int(np.searchsorted(prefix, prefix[start] + limit, "right")) - 1
        bound = int(bounds[np.searchsorted(bounds, reach, "right") - 1])
        hard = bound < n and (bound <= end or prefix[bound] - prefix[start] <= overlap)
        end = reach if hard else bound
        pieces.append((start, end, hard))
        start = int(np.searchsorted(prefix, prefix[end] - overlap, "left"))
    return pieces


def split_oversized(
    df: DataFrame,
    id_col: str,
    text_col: str,
    limit: int = 1000,
    overlap: int = 80,
    with_text: bool = True,
) -> DataFrame:
    """Ordered pieces of each text of more than `limit` tokens, by the characters / 4 + 1.25 x CJK estimate.

    Columns: id, piece (from 0), pieces, start, end (character offsets), tokens,
    hard (cut where no natural boundary was in reach), widest (tokens of the
    text's longest stretch between neighbouring boundaries), piece_text. A pass
    without a shuffle. Texts within the limit, null, empty or blank ones give no
    rows; a repeated row gives its pieces again. Texts of a quarter of the
    limit's characters or fewer never leave the JVM.
    """
    if overlap * 2 > limit or overlap < 0 or limit < 3:
        raise ValueError("the overlap must not exceed half the limit, and a piece must hold a character and its overlap")
    fields = [
        T.StructField(id_col, df.schema[id_col].dataType),
        *(T.StructField(c, T.IntegerType()) for c in ("piece", "pieces", "start", "end")),
        T.StructField("tokens", T.DoubleType()),
        T.StructField("hard", T.BooleanType()),
        T.StructField("widest", T.DoubleType()),
        *([T.StructField("piece_text", T.StringType())] if with_text else []),
    ]

    def split(batches):
        for batch in batches:
            ids, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                prefix = quarter_tokens(points)
                if prefix[-1] <= limit * 4:
                    continue
                bounds = natural_boundaries(points)
                widest = float(np.diff(prefix[bounds]).max()) / 4
                pieces = cut(prefix, bounds, limit * 4, overlap * 4)
                for k, (a, b, hard) in enumerate(pieces):
                    ids.append(i)
                    rows.append((k, len(pieces), a, b, float(prefix[b] - prefix[a]) / 4, hard, widest, *([text[a:b]] if with_text else [])))
                if len(rows) > 5000:
                    yield out(batch, ids, rows)
                    ids, rows = [], []
            if rows:
                yield out(batch, ids, rows)

    def out(batch, ids, rows):
        types = [pa.int32()] * 4 + [pa.float64(), pa.bool_(), pa.float64()] + [pa.string()] * with_text
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), *columns], names=[f.name for f in fields])

    text = F.col(text_col).cast("string")
    return (
        df.select(F.col(id_col), text.alias("__text"))
        .filter(F.length("__text") * (_CJK / 4) > limit)  # nothing shorter can exceed the limit
        .mapInArrow(split, T.StructType(fields))
    )


def oversized_items(df: DataFrame, id_col: str, text_col: str, limit: int = 1000, overlap: int = 80) -> DataFrame:
    """(id, cut): each oversized item once, with `forced` where the text has a stretch that no piece can hold whole."""
    pieces = split_oversized(df, id_col, text_col, limit, overlap, with_text=False)
    return (
        pieces.filter("piece = 0")
        .groupBy(id_col)
        .agg(F.max("widest").alias("__widest"))
        .select(id_col, F.when(F.col("__widest") > limit - overlap, "forced").otherwise("boundary").alias("cut"))
    )
