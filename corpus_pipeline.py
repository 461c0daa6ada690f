"""Training-data pipeline over ``documents``: five stages, each one operator
of ``turnstile.llm`` on all that the stage before it kept.

1. quality: documents that the classifier rejects go.
2. lines: lines that several documents repeat go, but for one document each.
3. copies: of near-duplicate documents (five-word shingles, similarity of 0.8
   or more) the one with the smallest id stays.
4. leaks: passages of the benchmark go; a document that is mostly such
   passages goes whole.
5. pieces: texts become SentencePiece ids; the last column tells whether
   decoding gives the text again.

The first four return the columns of ``documents``; ``n_chars`` follows the
text. Null texts stay null where a stage doesn't change them and count as
empty; an empty table gives empty results; extra columns pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnstile.llm import decontaminate, line_dedup, near_dup, pieces, quality
from turnstile.llm.common import read_table
from turnstile.session import ensure_checkpoint_dir


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    score = _free(docs, "score")
    model = quality.fit(spark, docs, read_table(spark, sf_dir, "labels"))
    if model is None:  # nothing to learn from: nothing is rejected
        return docs
    return quality.with_score(spark, docs, model, score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = {c: c if c not in ("n_lines", "n_dropped", "kept") else _free(docs, f"{c}_own") for c in docs.columns}
    done = line_dedup.line_dedup(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    changed = F.col("n_dropped") > 0
    made = {"text": F.when(changed, F.col("kept")).otherwise(F.col("text")),
            "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
            if "n_chars" in docs.columns else None}
    return done.select(*[(made[c] if c in made else F.col(f"`{n}`")).alias(c) for c, n in names.items()])


def stage_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.without_copies(spark, docs)


def stage_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(spark, docs, read_table(spark, sf_dir, "benchmark"))


def stage_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(spark, docs, check=True)


STAGES = [
    ("quality classifier", stage_quality),
    ("line dedup", stage_lines),
    ("MinHash near-dedup", stage_copies),
    ("benchmark decontamination", stage_leaks),
    ("SentencePiece encoding and decoding", stage_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each result is a Parquet table in the
    shared checkpoint folder, from which the next stage reads."""
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs


#: The classifier and the encoder can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
