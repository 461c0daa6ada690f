"""Stages of the pipeline on a small fixture."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import ODD, documents
from turnstile.llm import pieces

LEAK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
PAD = " ".join(f"pad{k}" for k in range(40))
LINE = "this very line is found in several documents"


def rows():
    good = [(i, (f"quiet words of document number{i} that says what no other says item{i} thing{i} place{i}" if i % 2 else
                 " ".join(f"{w}{i}" for w in (LEAK + " " + PAD).split()[:8 + i])) + f"\n{LINE}") for i in range(40)]
    junk = [(100 + i, "### $$$ %%% *** !!! " * (3 + i)) for i in range(40)]
    long = " ".join(f"long{k}" for k in range(60))
    return good + junk + [(200, long), (204, f"{LEAK} {PAD}"), (205, " ".join(f"more{k}" for k in range(50)) + f" {LEAK}\nand more"), (201, long + " end"), (202, f"{PAD} intro{LEAK} of words {LEAK}, and an end"), (203, f"{LEAK} pad1 pad2 pad3 pad4 pad5 pad6 pad7 pad8\n{LEAK}")]


@pytest.fixture()
def folder(spark, tmp_path):
    docs = documents(spark, rows() + [(300, None), (301, "")], "score long,kept string,row long,id string,hash string,n_lines long,coverage long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(not 100 <= i < 200), 0) for i, _ in rows()]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, LEAK)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = out.cache()
        texts.append({r.doc_id: r.text for r in docs.collect()})
        assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in docs.collect())
    quality, lines, copies, leaks = texts
    own = dict(rows())
    assert {d for d in own if d < 100 or d >= 200} <= quality.keys() and not any(100 <= d < 200 for d in quality)
    assert all(lines[d] == own[d].replace("\n" + LINE, "") for d in range(39)) and lines[39] == own[39]
    assert lines[200] == own[200]
    assert lines.keys() - copies.keys() == {201}
    # eleven of the twelve words are windows too where the first is glued to another word
    assert 203 not in leaks and leaks[202] == f"{PAD} introalpha  of words , and an end"
    assert all(leaks[d] == copies[d] for d in leaks if d not in (202, 204, 205))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in last} == leaks.keys() and all(r.round_trip for r in last)
    model = pieces.read_model()
    assert all(model.decode(r.ids) == (leaks[r.doc_id] or "") for r in last)


def test_run_is_all_stages(spark, folder):
    got = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(range(40)) | {200, 202} <= got and not got & {*range(100, 140), 201, 203}


def test_odd_and_empty_tables(spark, folder):
    for docs in (documents(spark, ODD), documents(spark, [])):
        for _, stage in corpus_pipeline.STAGES:
            n = docs.count()
            out = stage(spark, docs, folder)
            assert out.count() <= n
            docs = out if "text" in out.columns else docs


def test_without_labels_nothing_is_rejected(spark, folder, tmp_path):
    empty = tmp_path / "none"
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(str(empty / "labels.parquet"))
    docs = documents(spark, ODD)
    assert corpus_pipeline.stage_quality(spark, docs, str(empty)).count() == len(ODD)
    assert docs.where(F.col("text").isNull()).count() == 2
