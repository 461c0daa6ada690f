"""Quality classifier: a factorisation machine.

Inputs of a document are hashed words, binned structure statistics and the
recorded length (metadata). The score is linear weights plus low-rank
pairwise interactions, in time linear in the inputs by the identity
``sum_{i<j} <v_i, v_j> x_i x_j = (|sum x_i v_i|^2 - sum x_i^2 |v_i|^2) / 2``.

The model is fitted on at most ``SAMPLE_ROWS`` labelled documents outside
the test fold. Their texts become inputs inside Spark tasks; the driver gets
inputs only, bounded by that number. Scoring is one narrow pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from turnstile.llm.common import WORDS, held_out, labelled_sample, map_batches, read_table, text_bytes, unboxed

SAMPLE_ROWS = 4000
WORD_BUCKETS = 1024
RANK = 8
BINS = 8
STEPS = 150
THRESHOLD = 0.7

#: Byte classes whose shares of a text are statistics.
CLASSES = [bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b" ", b"\n\r", b".,;:?'\"()-",
           b"!", b"|<>{}[]/\\=_", b"#$%&*+@^`~", bytes(range(128, 256))]
N_STATS = len(CLASSES) + 7

INPUTS = "doc_id long, label int, held_out boolean, words array<int>, counts array<float>, stats array<float>"


def statistics(text: bytes, words: list[bytes], n_chars: int | None) -> list[float]:
    """Structure of a text; all shares, so that long texts don't stand out."""
    n = max(1, len(text))
    lines = text.split(b"\n")
    tokens = text.split()
    size = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, int)
    return [float(size[list(c)].sum()) / n for c in CLASSES] + [
        len(set(words)) / max(1, len(words)) ** 0.75,
        len(set(lines)) / len(lines),
        sum(map(len, words)) / max(1, len(words)),
        len(words) / max(1, len(tokens)),
        float(np.log1p(len(words))),
        float(np.log1p(n / len(lines))),
        float(np.log1p(n_chars)) if n_chars is not None and n_chars >= 0 else -1.0,
    ]


def word_inputs(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words with damped counts, of length 1 together."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    code = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
    count = np.bincount(code, minlength=buckets)
    at = np.flatnonzero(count)
    x = np.log1p(count[at])
    return at, (x / np.sqrt((x * x).sum())).astype(np.float32)


class FactorisationMachine:
    """Words, then a one-hot bin for each statistic, as inputs."""

    def __init__(self, edges: np.ndarray, buckets: int = WORD_BUCKETS, rank: int = RANK, seed: int = 7) -> None:
        self.edges, self.buckets = edges, buckets
        n = buckets + edges.shape[0] * (edges.shape[1] + 1)
        rng = np.random.default_rng(seed)
        self.bias = np.float32(0)
        self.w = np.zeros(n, np.float32)
        self.v = rng.normal(0, 0.05, (n, rank)).astype(np.float32)

    def stat_inputs(self, stats: Iterable[float]) -> np.ndarray:
        width = self.edges.shape[1] + 1
        return np.array([self.buckets + k * width + np.searchsorted(e, s, side="right")
                         for k, (e, s) in enumerate(zip(self.edges, stats, strict=True))])

    def row(self, words: np.ndarray, counts: np.ndarray, stats: Iterable[float]) -> tuple[np.ndarray, np.ndarray]:
        bins = self.stat_inputs(stats)
        return (np.concatenate([words, bins]),
                np.concatenate([counts, np.full(len(bins), 1 / np.sqrt(len(bins)), np.float32)]))

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.v[at] * x[:, None]
        s = v.sum(0)
        z = float(self.bias + self.w[at] @ x + 0.5 * (s @ s - (v * v).sum()))
        return 1 / (1 + np.exp(-max(-30.0, min(30.0, z))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, steps: int = STEPS,
            rate: float = 0.05, decay: float = 1e-4) -> None:
        """Full-batch Adam on the logistic loss; the sample is bounded, so it fits as one matrix."""
        X = np.zeros((len(rows), len(self.w)), np.float32)
        for k, (at, x) in enumerate(rows):
            X[k, at] = x
        X2 = X * X
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.w, self.v)]
        p0 = np.clip(y.mean(), 0.02, 0.98)
        self.bias = np.float32(np.log(p0 / (1 - p0)))
        for t in range(1, steps + 1):
            S = X @ self.v
            z = self.bias + X @ self.w + 0.5 * ((S * S).sum(1) - X2 @ (self.v * self.v).sum(1))
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)).astype(np.float32)
            gw = X.T @ g + decay * self.w
            gv = X.T @ (g[:, None] * S) - (X2.T @ g)[:, None] * self.v + decay * self.v
            self.bias -= np.float32(rate * g.sum())
            for p, d, (m, s) in zip((self.w, self.v), (gw, gv), state, strict=True):
                m += 0.1 * (d - m)
                s += 0.01 * (d * d - s)
                p -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-7)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS,
        buckets: int = WORD_BUCKETS) -> FactorisationMachine | None:
    """None if there is no labelled document to learn from."""
    sample = labelled_sample(spark, _columns(docs), labels, "quality", sample_rows)

    def start():
        def work(texts, part):
            lengths = part.column("n_chars").to_pylist()
            out = {"label": part.column("label"), "words": [], "counts": [], "stats": []}
            for text, n in zip(texts, lengths, strict=True):
                words = text.translate(WORDS).split()
                at, x = word_inputs(words, buckets)
                out["words"].append(at)
                out["counts"].append(x)
                out["stats"].append(statistics(text, words, n))
            return out

        return work

    rows = map_batches(sample, "label int, words array<int>, counts array<float>, stats array<float>", start)
    rows = rows.limit(2 * sample_rows).collect()  # more rows than ids only where ids repeat
    if not rows:
        return None
    stats = np.array([r.stats for r in rows])
    edges = np.array([np.quantile(s, np.arange(1, BINS) / BINS) for s in stats.T])
    # quantiles of the rarer class too: the bulk's own say nothing about the margin
    few = np.array([r.label for r in rows]) == 0
    if few.any() and not few.all():
        more = np.array([np.quantile(s[few], np.arange(1, BINS) / BINS) for s in stats.T])
        edges = np.sort(np.concatenate([edges, more], axis=1), axis=1)
    model = FactorisationMachine(edges, buckets)
    y = np.array([float(r.label >= 1) for r in rows], np.float32)
    model.fit([model.row(np.array(r.words, int), np.array(r.counts, np.float32), r.stats) for r in rows], y)
    return model


def _columns(docs: DataFrame) -> DataFrame:
    n = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), n.alias("n_chars"))


def with_score(spark: SparkSession, docs: DataFrame, model: FactorisationMachine | None,
               name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score (0 to 1, high: good).

    Null and empty texts have no words and the statistics of an empty text.
    A null n_chars is a value of its own; an absent column counts as null.
    Each row is scored for itself, so repeated rows get equal scores. Without
    a labelled document to learn from every score is 0.5. A column of
    ``docs`` that has the name of the score is replaced."""
    if model is None:
        return docs.withColumn(name, F.lit(0.5))
    shared = spark.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != "text"]
    n = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    own = docs.select(F.col("text").cast("binary").alias("text"), n.alias("n_chars"),
                      F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias(" ")).alias("row"))
    box = ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in own.schema["row"].dataType)

    def start():
        fm = shared.value

        def work(texts, part):
            score = []
            for text, chars in zip(texts, part.column("n_chars").to_pylist(), strict=True):
                text = text or b""
                words = text.translate(WORDS).split()
                score.append(fm.score(*fm.row(*word_inputs(words, fm.buckets), statistics(text, words, chars))))
            return {"text": part.column("text"), "row": part.column("row"), "score": score}

        return work

    scored = map_batches(own, f"text binary, row struct<{box}>, score double", start)
    return unboxed(scored, docs.columns, **{"text": F.col("text").cast("string"), name: F.col("score")})


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame,
            sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``score``, by a model that is fitted on ``labels``."""
    return with_score(spark, docs, fit(spark, docs, labels, sample_rows))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _columns(read_table(spark, sf_dir, "documents"))
    model = fit(spark, docs, read_table(spark, sf_dir, "labels"))
    return with_score(spark, docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
