import base64
import os

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemospark.llm import bpe, packing, split, tokens

RANKS = os.path.join(bpe.TOKENIZER_DIR, bpe.DEFAULT_RANKS)
pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no tokenizer files")

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
HARD = ["", " ", "  a", "a  b", "it's we'll they've I'd 'S ''s \"'s", "a\n\n b\t\tc ", "中文，混合 text。　x", "🙂🙂 é \x1c\x85​﻿", "x" * 600, "ab" * 700, " " * 50]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_hard_texts(reference):
    got = bpe.load().encode(pa.array([*HARD, None])).to_pylist()
    assert got == [*(reference.encode_ordinary(x) for x in HARD), []]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("'strvemld  \n\tA1é中🙂-_.　\x85²"), max_size=24), min_size=1, max_size=20))
def test_like_the_reference_encoder(reference, texts):
    assert bpe.load().encode(pa.array(texts)).to_pylist() == [reference.encode_ordinary(x) for x in texts]


def test_the_other_rank_file():
    import tiktoken

    path = os.path.join(bpe.TOKENIZER_DIR, "byte_bpe_multi_50k.tiktoken")
    if not os.path.exists(path):
        pytest.skip("no second rank file")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("multi", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*HARD, "Der Nachtlauf prüft die alten Einträge.", "缓存层清理了空白回复，结果与基线一致。" * 40, "Le collecteur archive l'aperçu."]
    assert bpe.load(path).encode(pa.array(texts)).to_pylist() == [other.encode_ordinary(x) for x in texts]


def test_round_trip(spark):
    texts = [*HARD, None, "缓存 mixed ünïcode \U0001f642"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    back = tokens.decode_corpus(tokens.encode_corpus(df, "doc_id", "text"), "doc_id", "ids")
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    odd = spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>")
    assert [r["text"] for r in tokens.decode_corpus(odd, "doc_id", "ids").collect()] == ["", ""]


def test_encode_corpus(spark, reference):
    rows = [(1, "it's new", "x"), (2, None, "x"), (3, "", None), (1, "it's new", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in tokens.encode_corpus(df, "doc_id", "text").collect())
    assert got == sorted([(1, reference.encode_ordinary("it's new"))] * 2 + [(2, []), (3, [])])
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_packing(spark):
    rows = [(i, "word " * (i * 7 % 90)) for i in range(200)] + [(900, "word " * 1000), (901, None), (902, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    packed = packing.pack_documents(df, "doc_id", "text", capacity=128, windows=4)
    boxes = {r["container"]: r["n"] for r in packed.groupBy("container").agg(F.sum("tokens").alias("n")).collect()}
    assert max(boxes.values()) <= 128
    sizes = {r["doc_id"]: r["tokens"] for r in tokens.count_tokens(df, "doc_id", "text").collect()}
    placed = {r["doc_id"]: (r["n"], r["k"], r["sized"]) for r in packed.groupBy("doc_id").agg(F.sum("tokens").alias("n"), F.count("*").alias("k"), F.max("tokens").alias("sized")).collect()}
    assert {k: v[0] for k, v in placed.items()} == sizes
    assert all(v[1] == 1 for k, v in placed.items() if sizes[k] <= 128) and placed[900][1] == -(-sizes[900] // 128)
    fill = packing.container_fill(packed, 128).first()
    assert fill["tokens"] == sum(sizes.values()) and fill["fill"] > 0.85  # few windows, few items
    assert packing.pack_documents(df.limit(0), "doc_id", "text").count() == 0


def brute_cut(text, limit, overlap):
    """The same pieces by a scan of characters."""
    cost = [6 if split.quarter_tokens(np.array([ord(c)], np.uint32))[1] == 6 else 1 for c in text]
    ends = {len(text)}
    for i, c in enumerate(text):
        if c in "\n。！？" or c in ".!?" and i + 1 < len(text) and text[i + 1].isspace():
            ends.add(i + 1)
    out, start, end = [], 0, 0
    while end < len(text):
        total, reach, best = 0, start, None
        while reach < len(text) and total + cost[reach] <= limit:
            total += cost[reach]
            reach += 1
            if reach in ends and reach > end and (total > overlap or reach == len(text)):
                best = reach
        hard = best is None
        end = reach if hard else best
        out.append((start, end, hard))
        start, total = end, 0
        while start > 0 and total + cost[start - 1] <= overlap:
            start -= 1
            total += cost[start]
    return out


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab. \n!中。"), min_size=1, max_size=300))
def test_cut_like_a_scan(text):
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    got = split.cut(split.quarter_tokens(points), split.natural_boundaries(points), 40, 12)
    assert got == brute_cut(text, 40, 12)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(a[0] < b[0] <= a[1] < b[1] for a, b in zip(got, got[1:]))  # each begins after the one before, without a gap


@pytest.mark.parametrize("text", ["aaa. 中中中中中中", "a. " + "b" * 80, "中。" + "中" * 30, "a.\n" * 2 + "b" * 200])
def test_no_piece_is_repeated_whole(text):
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    got = split.cut(split.quarter_tokens(points), split.natural_boundaries(points), 40, 12)
    assert got == brute_cut(text, 40, 12) and all(b[0] > a[0] for a, b in zip(got, got[1:]))


def test_split_oversized(spark):
    long, forced = "One more sentence. " * 300, "x" * 9000
    rows = [("a", long, 1), ("a", long, 2), ("b", forced, 1), ("c", "short", 1), ("d", None, 1), ("e", "", 1), ("f", "中" * 667, 1), ("g", "中" * 666, 1), (None, long, 1)]
    df = spark.createDataFrame(rows, "memory_id string, content string, piece int")
    pieces = split.split_oversized(df, "memory_id", "content").collect()
    assert all(p["tokens"] <= 1000 for p in pieces) and {p["memory_id"] for p in pieces} == {"a", "b", "f", None}
    own = sorted({(p["piece"], p["start"], p["end"]) for p in pieces if p["memory_id"] == "a"})
    assert own[0][1] == 0 and own[-1][2] == len(long)
    assert all(0 < a[2] - b[1] <= 320 for a, b in zip(own, own[1:]))
    assert all(long[p["end"] - 1] == "." or p["end"] == len(long) for p in pieces if p["memory_id"] == "a")
    found = {r["memory_id"]: r["cut"] for r in split.oversized_items(df, "memory_id", "content").collect()}
    assert found == {"a": "boundary", "b": "forced", "f": "forced", None: "boundary"}
    assert split.oversized_items(df.limit(0), "memory_id", "content").count() == 0
