import os

import numpy as np
import pytest

from mnemospark.llm import level

FOLDER = "/root/testdata/sf0.001"


def test_boosted_trees_learn_a_step():
    rng = np.random.default_rng(0)
    x = rng.random((300, 4))
    y = (x[:, 2] > 0.5) * 2.0 + (x[:, 1] > 0.3)
    fitted = level.BoostedTrees().fit(x[:200], y[:200])
    assert np.abs(fitted.predict(x[200:]) - y[200:]).mean() < 0.1


@pytest.fixture(scope="module")
def model(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return level.train_level_model(spark.read.parquet(f"{FOLDER}/level_samples.parquet"))


def test_held_out_accuracy(model):
    assert model.held_out_accuracy >= 0.95


def test_grades(spark, model):
    plain = "The map sends the list. You can hold the bell once more. Is the code small? " * 4
    hard = "The interpolation underlying irreversible dissemination undermines the transitive normalization of incommensurable interoperability. " * 5
    rows = [
        (1, plain), (2, hard), (3, None), (4, ""), (5, "Is the file free?"), (6, "```\nlet a = b.load(3)?;\n```\n" * 40), (7, "Der Nachtlauf ersetzt den leeren Anhang und prüft die alten Einträge. " * 10),
        (8, "缓存层清理了空白回复，结果与基线一致。" * 30), (9, "# Title\n\nUser: " + plain + "\nsrc/a/b.rs\n```\nx = 1\n```"), (10, hard * 200), (1, plain),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS grade", "2 AS score")
    got = sorted((r["doc_id"], r["grade"]) for r in level.reading_levels(df, "doc_id", "text", model).collect())
    assert got == [(1, 1), (1, 1), (2, 3), (9, 1), (10, 3)]
    assert level.reading_levels(df.limit(0), "doc_id", "text", model).count() == 0


def test_too_few_samples(spark):
    with pytest.raises(ValueError):
        level.train_level_model(spark.createDataFrame([("a", 1)], "sample_text string, grade long"))


def test_validation_by_source(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    samples = spark.read.parquet(f"{FOLDER}/level_samples.parquet").selectExpr("*", "concat('s', sample_id % 4) AS source")
    assert level.train_level_model(samples, source_col="source").held_out_accuracy >= 0.9
    with pytest.raises(ValueError):
        level.train_level_model(samples.withColumn("source", samples["source"].substr(1, 1)), source_col="source")


def test_a_block_that_is_not_closed():
    assert level.prose("a\n```\ncode\n```\nb") .split() == ["a", "b"] and level.prose("a\n```\ncode\n```\nb\n```\nrest").split() == ["a", "b", "rest"]
