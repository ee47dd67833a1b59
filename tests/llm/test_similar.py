import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import knn, neardup


def brute(texts, run, least, threshold):
    sets = []
    for key, text in texts:
        s = "".join(c for c in (text or "").lower() if c.isalnum())
        if key is not None and text is not None and len(s) >= least:
            sets.append((key, {s[i : i + run] for i in range(len(s) - run + 1)}))
    out = set()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a != b and len(x & y) / len(x | y) >= threshold:
                out.add((min(a, b), max(a, b)))
    return out


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(60)]
        rows.append((f"k{i}", " ".join(text)))
        if i % 4 == 0:
            for j in range(rng.randint(1, 3)):
                edited = text[:]
                for _ in range(rng.randint(0, 5)):
                    edited[rng.randrange(60)] = rng.choice(words)
                rows.append((f"k{i}_{j}", " ".join(edited).upper()))
    return rows


def links_of(spark, rows, **options):
    df = spark.createDataFrame(rows, "key string, body string").withColumns({"id": F.lit(1), "text": F.lit("clash"), "same": F.lit(2)})
    links, members = neardup.similar_texts(df, "key", "body", **options)
    return links, members, {(r[0], r[1]) for r in neardup.expand_links(links, members).collect()}


def test_like_brute_force(spark):
    rows = corpus(160) + [("n", None), (None, "x" * 200), ("e", ""), ("short", "abc")] + [("k0", corpus(1)[0][1])]
    _, members, got = links_of(spark, rows, run=5, least=100)
    want = brute(rows, 5, 100, 0.6)
    assert got <= want and len(want - got) <= 0.03 * len(want)
    assert not {"n", "e", "short", None} & {r["id"] for r in members.collect()}


def titles(n=150, seed=4):
    """Short texts in pairs of about the threshold, which 64 grouped prefixes miss often."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for i in range(n):
        text = [rng.choice(letters) for _ in range(rng.choice([12, 14, 20, 30, 42]))]
        edited = text[:]
        for _ in range(1 if len(text) < 30 else 2):
            edited[rng.randrange(len(text))] = rng.choice(letters)
        rows += [(f"t{i:03}", "".join(text)), (f"t{i:03}_e", "".join(edited) + rng.choice(["", "x", "."]))]
    return rows


@pytest.mark.parametrize("block", [2000, 1])
def test_exact_join_of_titles(spark, block):
    rows = titles() + [(f"c{i}", f"Notes of the retry window {i}") for i in range(25)]
    _, _, got = links_of(spark, rows, run=3, least=12, exact=True, block=block)
    assert got == brute(rows, 3, 12, 0.6)


def test_title_query_joins_exactly(spark, tmp_path):
    from mnemospark.llm import queries

    rows = titles()
    spark.createDataFrame(rows, "hook_id string, summary_title string").write.parquet(f"{tmp_path}/hooks.parquet")
    spark.createDataFrame([], "memory_id string, content string").write.parquet(f"{tmp_path}/memories.parquet")
    got = {(r["key_a"], r["key_b"]) for r in queries.p4_found(spark, str(tmp_path)).collect()}
    assert got == brute(rows, 3, 12, 0.6)


def test_links_of_memories_and_hooks(spark, tmp_path):
    from mnemospark.llm import queries

    text, title = corpus(1, 7)[0][1], "the retry window of the cache"
    spark.createDataFrame([("m1", text), ("m2", text + " and more"), ("m3", "x" * 150)], "memory_id string, content string").write.parquet(f"{tmp_path}/memories.parquet")
    spark.createDataFrame([("h1", title), ("h2", title + "s"), ("h3", title.upper())], "hook_id string, summary_title string").write.parquet(f"{tmp_path}/hooks.parquet")
    got = {(r["kind"], r["key"], r["representative"], r["links"]) for r in queries.p4_links(spark, str(tmp_path)).collect()}
    assert got == {("content", "m1", "m1", 1), ("content", "m2", "m2", 1), ("content", "m3", "m3", 0), ("title", "h1", "h1", 1), ("title", "h2", "h2", 1), ("title", "h3", "h1", 1)}


def test_copies_are_one_representative(spark):
    text = corpus(1, 7)[0][1]
    rows = [(f"c{i:04}", text if i % 2 else text.upper() + "!!") for i in range(400)]
    links, members, _ = links_of(spark, rows[:40], run=5, least=100)
    assert links.count() == 0 and {r["representative"] for r in members.collect()} == {"c0000"}
    links, members = neardup.similar_texts(spark.createDataFrame(rows, "key string, body string"), "key", "body", run=5, least=100)
    assert links.count() == 0 and members.count() == 400


def test_large_groups_are_compared_in_blocks(spark):
    rng = random.Random(3)
    base = corpus(1, 5)[0][1].split()
    rows = []
    for i in range(60):
        text = base[:]
        text[rng.randrange(60)] = f"edit{i}"
        rows.append((f"g{i:02}", " ".join(text)))
    _, _, got = links_of(spark, rows, run=5, least=100, block=10)
    assert got == brute(rows, 5, 100, 0.6)


def test_no_texts(spark):
    links, members, got = links_of(spark, [("a", None)], run=5, least=100)
    assert not got and links.count() == members.count() == 0


def vectors(spark, n=600, seed=2):
    rng = np.random.default_rng(seed)
    rows, t = [], dt.datetime(2025, 1, 1)
    for i in range(n):
        v = rng.standard_normal(64)
        rows.append((f"h{i:04}", v, t))
        for j in range(i % 9 if i % 5 == 0 else 0):
            rows.append((f"h{i:04}_{j}", v * 3 + rng.standard_normal(64) * 0.4, t))
    rows = [(k, [float(x) for x in v], t) for k, v, t in rows]
    rows += [("twin1", [1.0] * 64, t), ("twin2", [2.0] * 64, t), ("old", [1.0] * 64, t), ("old", [0.0] * 64, t + dt.timedelta(1)), ("nan", [math.nan] * 64, t), ("inf", [math.inf] + [1.0] * 63, t),
             ("short", [1.0] * 63, t), ("none", None, t), ("hole", [None] + [1.0] * 63, t), (None, [1.0] * 64, t), ("huge", [1e38] * 64, t), ("tiny", [1e-40] * 64, t)]
    return spark.createDataFrame(rows, "hook_id string, v array<float>, at timestamp")


@pytest.fixture(scope="module")
def units(spark):
    df = knn.sound_vectors(vectors(spark), "hook_id", "v", "at", 64).cache()
    return df, {r["id"]: np.array(r["unit"], float) for r in df.collect()}


def test_sound_vectors(units):
    _, by_id = units
    assert not {"old", "nan", "inf", "short", "none", "hole", None} & set(by_id) and {"twin1", "huge", "tiny"} <= set(by_id)
    assert all(abs((v * v).sum() - 1) < 1e-5 for v in by_id.values())


def nearest(by_id, k, least=-2):
    ids = sorted(by_id)
    m = np.array([by_id[i] for i in ids])
    s = np.round(m @ m.T, 6)
    np.fill_diagonal(s, -3)
    return {a: [(ids[j], s[i, j]) for j in np.lexsort((np.arange(len(ids)), -s[i]))[:k] if s[i, j] >= least] for i, a in enumerate(ids)}


def test_pairs_like_brute_force(spark, units):
    df, by_id = units
    found = knn.nearest_vectors(df, k=5, min_cosine=0.9, leaf_rows=64)
    got = {(r["a"], r["b"]) for r in knn.similar_pairs(found, 0.9).collect()}
    want = {(min(a, b), max(a, b)) for a, near in nearest(by_id, 5, 0.9).items() for b, _ in near}
    assert len(got ^ want) <= 0.02 * len(want) and ("twin1", "twin2") in got


def test_recall_of_all_neighbours(spark, units):
    df, by_id = units
    asked = df.filter("pmod(xxhash64(id), 5) = 0")
    got: dict = {}
    for r in knn.nearest_vectors(df, asked, k=5, leaf_rows=64).collect():
        got.setdefault(r["query"], set()).add(r["neighbour"])
    want = nearest(by_id, 5)
    assert np.mean([len(got[a] & {b for b, _ in want[a]}) / 5 for a in got]) >= 0.9
    assert len(got) == asked.count() and all(len(x) == 5 for x in got.values())


def test_equal_vectors_fill_one_leaf(spark):
    df = spark.range(700).selectExpr("concat('e', id) AS id", "transform(sequence(1, 64), x -> float(0.125)) AS unit")
    found = knn.nearest_vectors(df, df.limit(3), k=5, min_cosine=0.9, leaf_rows=32)
    assert found.count() == 15
    assert knn.nearest_vectors(df.limit(0), k=5).count() == 0


def test_chi_square_quantile():
    assert abs(knn.chi_square_quantile(0.95, 10) - 18.307) < 0.01 and abs(knn.chi_square_quantile(0.99, 12) - 26.217) < 0.01


def test_neighbours_query_keeps_the_default_stop(spark, tmp_path, monkeypatch):
    from mnemospark.llm import queries

    vectors(spark, 40).withColumnsRenamed({"v": "vector", "at": "embedded_at"}).write.parquet(f"{tmp_path}/hook_vectors.parquet")
    options = []
    monkeypatch.setattr(queries.knn, "nearest_vectors", lambda *args, **kwargs: options.append(kwargs))
    queries.p5_neighbours(spark, str(tmp_path))
    assert options == [{"k": 5}]
