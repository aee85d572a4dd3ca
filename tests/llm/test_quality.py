"""The quality ranker learns from every labelled document that isn't held out."""

import zlib

import numpy as np
import pytest
from casemill.llm import quality
from casemill.llm.common import Scratch
from pyspark.sql import functions as F

SIZE = len(quality.FEATURES)


def test_all_labelled_documents_are_learnt_from(spark):
    """More than 20,000 of them, beside documents without a label."""
    n = 27_000
    docs = spark.range(0, 2 * n, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.range(0, 2 * n, 4).select(F.col("id").alias("doc_id"), (F.col("id") % 3 != 0).cast("int").alias("quality")).union(spark.range(2, 2 * n, 4).selectExpr("id", "1"))
    docs = docs.union(spark.range(1, 2000, 2).selectExpr("id", "'no label'"))
    want = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(0, 2 * n, 2))
    assert quality.training_rows(docs, labels).count() == want > 20_000


def padded(*x):
    return [float(v) for v in x] + [0.0] * (SIZE - len(x))


@pytest.mark.parametrize("few", [0, 10_000])
def test_each_document_is_in_a_pair(spark, monkeypatch, few):
    """By a shuffle and by a broadcast, with fewer and with more documents labelled 1 than have partners."""
    monkeypatch.setattr(quality, "FEW", few)
    for zeros, ones in ((1, 1), (1, 50), (3, 25), (40, 3), (7, 20)):
        rows = spark.createDataFrame([(float(k), i, [float(k), float(i)]) for k, m in ((0, zeros), (1, ones)) for i in range(m)], "label double, pos long, x array<double>")
        pairs = [(r["x0"][1], r["x1"][1], r["x0"][0], r["x1"][0]) for r in quality.preferences(rows, zeros, ones, 8).collect()]
        assert {p[2:] for p in pairs} == {(0.0, 1.0)} and len(pairs) == max(8 * zeros, ones)
        assert {p[0] for p in pairs} == set(range(zeros)) and {p[1] for p in pairs} == set(range(ones))


def test_documents_beyond_the_first_partners_are_learnt_from(spark):
    """One document labelled 0: those labelled 1 that follow its eight first ones are all that have the second feature."""
    rows = [(0.0, padded(0, 0))] + [(1.0, padded(1, 0))] * 8 + [(1.0, padded(1, 1 + k / 90)) for k in range(42)]
    ranker = quality.fit(spark.createDataFrame(rows, "label double, x array<double>").coalesce(1))
    assert ranker.weights[0] > 0 and ranker.weights[1] > 0
    worth = (np.array([x for _, x in rows]) - ranker.centre) @ np.array(ranker.weights)
    assert ranker.threshold == pytest.approx(np.quantile(worth, 1 / 51))


def test_quantile_is_exact(spark):
    values = np.random.default_rng(3).normal(size=997).round(2)
    df = spark.createDataFrame([(float(v),) for v in values], "value double").repartition(13)
    with Scratch(spark) as keep:
        for share in (0.0, 0.137, 0.5, 1.0):
            assert quality.quantile(df, share, len(values), keep) == pytest.approx(np.quantile(values, share), abs=1e-12)
