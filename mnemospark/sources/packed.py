"""MessagePack documents: maps, lists, texts, numbers, truth values and nulls, of the public format."""

from __future__ import annotations

import json
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(value) -> bytes:
    """One value as MessagePack."""
    if value is None:
        return b"\xc0"
    if isinstance(value, bool):
        return b"\xc3" if value else b"\xc2"
    if isinstance(value, int):
        if 0 <= value < 128 or -32 <= value < 0:
            return struct.pack("b" if value < 0 else "B", value)
        return b"\xd3" + struct.pack(">q", value) if value < 1 << 63 else b"\xcf" + struct.pack(">Q", value)
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, bytes):
        return b"\xc6" + struct.pack(">I", len(value)) + value
    if isinstance(value, str):
        raw = value.encode()
        return (bytes([0xA0 | len(raw)]) if len(raw) < 32 else b"\xdb" + struct.pack(">I", len(raw))) + raw
    if isinstance(value, dict):
        head = bytes([0x80 | len(value)]) if len(value) < 16 else b"\xdf" + struct.pack(">I", len(value))
        return head + b"".join(pack(k) + pack(v) for k, v in value.items())
    head = bytes([0x90 | len(value)]) if len(value) < 16 else b"\xdd" + struct.pack(">I", len(value))
    return head + b"".join(map(pack, value))


_NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_SIZES = {0xC4: ">B", 0xC5: ">H", 0xC6: ">I", 0xD9: ">B", 0xDA: ">H", 0xDB: ">I", 0xDC: ">H", 0xDD: ">I", 0xDE: ">H", 0xDF: ">I"}


def unpack(raw: bytes):
    """The one value of a MessagePack document; ValueError for anything else."""
    try:
        value, end = _value(memoryview(raw), 0)
    except (struct.error, IndexError, UnicodeDecodeError) as e:
        raise ValueError("damaged document") from e
    if end != len(raw):
        raise ValueError("more than one value")
    return value


def _value(raw: memoryview, at: int):
    kind = raw[at]
    at += 1
    if kind < 0x80 or kind >= 0xE0:
        return (kind if kind < 0x80 else kind - 256), at
    if kind in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[kind], at
    if form := _NUMBERS.get(kind):
        return struct.unpack_from(form, raw, at)[0], at + struct.calcsize(form)
    if form := _SIZES.get(kind):
        size = struct.unpack_from(form, raw, at)[0]
        at += struct.calcsize(form)
    elif kind < 0xC0:
        size = kind & (0x1F if kind >= 0xA0 else 0x0F)
    else:
        raise ValueError("a type that documents do not use")
    if kind in (0xC4, 0xC5, 0xC6) or 0xA0 <= kind < 0xC0 or kind in (0xD9, 0xDA, 0xDB):
        if at + size > len(raw):
            raise ValueError("cut document")
        part = bytes(raw[at : at + size])
        return (part if kind in (0xC4, 0xC5, 0xC6) else part.decode()), at + size
    is_map = kind & 0xF0 == 0x80 or kind in (0xDE, 0xDF)
    items = []
    for _ in range(size * (2 if is_map else 1)):
        item, at = _value(raw, at)
        items.append(item)
    return (dict(zip(items[::2], items[1::2])) if is_map else items), at


def to_packed(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, document binary): each row as one map of its columns, by way of JSON values."""

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(json.loads(x)) for x in batch.column(1).to_pylist()], pa.binary())], names=[id_col, "document"])

    kind = dict(rows.dtypes)[id_col]
    return rows.select(id_col, F.to_json(F.struct(*rows.columns)).alias("__json")).mapInArrow(packed, f"`{id_col}` {kind}, document binary")


def from_packed(documents: DataFrame, id_col: str, schema: str) -> DataFrame:
    """The rows of packed documents by a schema; a damaged document gives nulls beside its id, as JSON does."""

    def unpacked(batches):
        for batch in batches:
            out = []
            for raw in batch.column(1).to_pylist():
                try:
                    out.append(None if raw is None else json.dumps(unpack(raw)))
                except (ValueError, TypeError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["__id", "__json"])

    kind = dict(documents.dtypes)[id_col]
    rows = documents.select(id_col, "document").mapInArrow(unpacked, f"__id {kind}, __json string")
    return rows.select("__id", F.from_json("__json", schema).alias("m")).select(F.col("__id").alias(f"{id_col}_of"), "m.*")
