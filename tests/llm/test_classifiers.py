"""Classifiers: exact parts against brute force, the rest by held-out accuracy."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD, documents
from turnstile.llm import common, quality, toxicity
from turnstile.sources.tables import read_table

SF = "/root/testdata/sf0.1"


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    fm = quality.FactorisationMachine(np.sort(rng.normal(size=(3, 4))), buckets=16, rank=3)
    fm.w = rng.normal(size=len(fm.w)).astype(np.float32)
    at, x = fm.row(np.array([1, 5, 9]), np.array([0.5, 0.3, 0.2], np.float32), [0.1, -2.0, 9.0])
    z = fm.bias + sum(fm.w[i] * a for i, a in zip(at, x))
    for i in range(len(at)):
        for j in range(i):
            z += float(fm.v[at[i]] @ fm.v[at[j]]) * x[i] * x[j]
    assert abs(fm.score(at, x) - 1 / (1 + np.exp(-z))) < 1e-6


def test_gradient_by_differences():
    rng = np.random.default_rng(1)
    rows = [(np.array([0, 3, 5]), np.array([1.0, 0.5, 0.2], np.float32)), (np.array([1, 3]), np.array([0.3, 1.0], np.float32))] * 10
    y = np.array([1.0, 0.0] * 10, np.float32)
    fm = quality.FactorisationMachine(np.zeros((1, 1)), buckets=6, rank=2)
    fm.v = rng.normal(0, 0.3, fm.v.shape).astype(np.float32)

    def loss():
        p = np.array([fm.score(*r) for r in rows])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    before = loss()
    fm.fit(rows, y, steps=60)
    assert loss() < 0.2 * before


def test_folds(spark):
    rows = spark.range(500).select(F.col("id").alias("doc_id")).withColumn("h", common.held_out()).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert spark.createDataFrame([(None,)], "doc_id long").select(common.held_out()).first()[0] is False


def test_sample_leaves_out_the_test_fold_and_is_bounded(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(200)] + [(None, "x")])
    labels = spark.createDataFrame([(i, i % 5 == 0, 1) for i in range(200)] * 2 + [(None, True, 1), (3, None, 1)],
                                   "doc_id long, toxic boolean, lang int").withColumn("toxic", F.col("toxic").cast("int"))
    some = common.labelled_sample(spark, docs.select("doc_id", "text"), labels, "toxic", 20, each=True).collect()
    assert len(some) == 20 and sum(r.label for r in some) == 10
    assert not any(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in some)


def accuracy(spark, scored, label):
    labels = read_table(spark, SF, "labels").select("doc_id", label)
    rows = scored.where("held_out").join(labels, "doc_id").select("predicted", "score", label).collect()
    return np.array([r.predicted for r in rows]), np.array([r.score for r in rows]), np.array([r[label] for r in rows])


def area(score, y):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    n = y.sum()
    return (order[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def test_quality_held_out(spark):
    predicted, score, y = accuracy(spark, quality.op8_quality(spark, SF), "quality")
    assert len(y) > 300 and (predicted == y).mean() > 0.97
    assert predicted[y == 1].mean() > 0.97 and area(score, y) > 0.97


def test_toxicity_held_out(spark):
    predicted, score, y = accuracy(spark, toxicity.op5_toxicity(spark, SF), "toxic")
    assert area(score, y) > 0.93
    assert predicted[y == 1].mean() > 0.75 and predicted[y == 0].mean() < 0.05


def test_labels_lang_source_and_id_are_no_input(spark):
    rows = [(i, "plain words here " * 5) for i in range(40)] + [(100 + i, "### $$$ %%% !!!") for i in range(40)]
    labels = spark.createDataFrame([(d, int(d < 100), 0) for d, _ in rows], "doc_id long, quality int, toxic int")
    model = quality.fit(spark, documents(spark, rows), labels)
    docs = documents(spark, [(7, "plain words here"), (8, "plain words here")])
    docs = docs.withColumn("lang", F.col("doc_id").cast("string")).withColumn("source", F.col("doc_id").cast("string"))
    assert len({r.score for r in quality.with_score(spark, docs, model).collect()}) == 1


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, 1, 0), (6, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = odd.withColumn("score", F.lit("own")).withColumn("row", F.lit(1)).withColumn("label", F.lit(2))
    good = quality.quality(spark, docs, labels)
    assert good.columns == docs.columns and good.count() == len(ODD)
    assert all(0 <= r.score <= 1 for r in good.collect())
    assert {(r.doc_id, r.text) for r in good.collect()} == set(ODD)
    bad = toxicity.toxicity(spark, docs, labels).collect()
    assert len(bad) == len(ODD) and all(0 <= r.score <= 1 for r in bad)
    for empty in (labels.limit(0), labels.where("doc_id = 1")):
        assert quality.quality(spark, odd, empty).count() == len(ODD)
        assert {r.score for r in toxicity.toxicity(spark, odd, empty).collect()} == {0.0}
    assert quality.quality(spark, nothing, labels).count() == 0
    assert toxicity.toxicity(spark, nothing, labels).count() == 0


def test_windows_cover_all_words():
    words = [f"w{i}".encode() for i in range(1000)]
    assert b"".join(toxicity.windows(words)).split() == words
    assert toxicity.windows([]) == []


@pytest.mark.parametrize("where", ["a", "b", "c"])
def test_a_planted_word_in_any_place_counts(where):
    rng = np.random.default_rng(5)
    def plain(n): return [("".join(rng.choice(list("aeinrst"), 6))).encode() for _ in range(n)]
    def foul(n, at): w = plain(n); w[at:at] = [b"vilename", b"foulword"]; return w
    toxic = [foul(80, int(rng.integers(80))) for _ in range(60)]
    calm = [plain(80) for _ in range(200)]
    d = toxicity.Distance(toxicity.ordinary_content(calm), toxicity.toxic_content(toxic, calm))
    at = {"a": 0, "b": 1500, "c": 2999}[where]
    assert d.features(foul(3000, at))[0] > d.features(plain(3000))[0]
