"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on what
toxic texts have and ordinary ones lack. A window of a text is compressed
with the ordinary dictionary and with both; the bytes that the toxic one
saves are the window's distance. (The toxic content is small and lies nearest
to the window, so matches in the ordinary content cost about the same in both
runs and what differs is toxic content.) Windows that save bytes are looked
at word by word in the same way. The largest and the mean savings of all windows of
the whole text give the score, by a logistic curve that is calibrated on
labelled texts which the dictionaries haven't seen.

The model is fitted on at most ``SAMPLE_ROWS`` labelled documents outside
the test fold, up to half of them of either class. Scoring is one narrow
pass; nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections import Counter
from heapq import nlargest

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from turnstile.llm.common import WORDS, held_out, labelled_sample, map_batches, read_table, text_bytes

SAMPLE_ROWS = 6000
WINDOW = 64
ORDINARY_BYTES = 16384
TOXIC_BYTES = 4096
THRESHOLD = 0.3
#: A stem of a toxic text counts if its share of toxic texts is so many times that of ordinary ones.
CONTRAST = 30
STEM = (4, 14)
MEMO_WORDS = 200_000
#: A run of one byte behind each window: a block that hardly gets smaller would be stored as it is.
PAD = b"~" * 48

#: Odd numbers, each of which orders hashes in its own way.
MIXERS = [2654435761 + 2 * 97 ** k % 4294967296 // 2 * 2 for k in range(1, 9)]

PARAMETERS = dict(min_match=4, strategy=zstandard.STRATEGY_GREEDY, hash_log=14, chain_log=14, search_log=3,
                  write_content_size=0, write_checksum=0, write_dict_id=0)


def windows(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """All words of a text in runs of about ``size`` bytes, spaces at both ends."""
    out, at, n = [], 0, 0
    for i, w in enumerate(words):
        n += len(w) + 1
        if n >= size:
            out.append(b" " + b" ".join(words[at:i + 1]) + b" ")
            at, n = i + 1, 0
    if at < len(words):
        out.append(b" " + b" ".join(words[at:]) + b" ")
    return out


def stems(words: list[bytes]) -> set[bytes]:
    """Starts of the words, and whole words with the space that ends them."""
    out = set()
    for w in set(words):
        out.update(w[:k] for k in range(STEM[0], min(len(w), STEM[1]) + 1))
        if STEM[0] <= len(w) < STEM[1]:
            out.add(w + b" ")
    return out


def unlike(texts: list[tuple[list[bytes], int]]) -> list[tuple[list[bytes], int]]:
    """Texts (words, label) without those that are near copies of one before:
    what a group of copies repeats is no evidence. Near are texts that share
    three of eight minimum hashes of their word pairs."""
    seen: dict[tuple[int, int], list[int]] = {}
    kept = []
    for words, label in texts:
        h = np.fromiter(map(zlib.crc32, map(b" ".join, zip(words, words[1:]))), np.uint64, max(0, len(words) - 1))
        marks = [(k, int((h * np.uint64(m) & np.uint64(0xFFFFFFFF)).min())) for k, m in enumerate(MIXERS)] if len(h) else []
        met = Counter(i for m in marks for i in seen.get(m, ()))
        if met and max(met.values()) >= 3:
            continue
        for m in marks:
            seen.setdefault(m, []).append(len(kept))
        kept.append((words, label))
    return kept


def toxic_content(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> bytes:
    """Stems that set toxic texts apart, most frequent last (nearest)."""
    seen: Counter = Counter()
    for words in toxic:
        seen.update(stems(words))
    least = max(3, 0.01 * len(toxic))
    seen = Counter({s: n for s, n in seen.items() if n >= least})
    plain: Counter = Counter()
    for words in ordinary:
        plain.update(s for s in stems(words) if s in seen)
    good = {s: n for s, n in seen.items()
            if n / len(toxic) > CONTRAST * (plain[s] + 0.5) / max(1, len(ordinary))}
    longer: dict[bytes, list[bytes]] = {}
    for s in good:
        for k in (1, 2):
            longer.setdefault(s[:-k], []).append(s)

    def grown(s: bytes) -> bytes:
        n = good[s]
        while more := [x for x in longer.get(s, []) if good[x] >= 0.8 * n]:
            s = max(more, key=lambda x: (good[x], -len(x), x))
        return s

    shortest = [s for s in good if not any(s[:k] in good for k in range(STEM[0], len(s)))]
    best = nlargest(TOXIC_BYTES // STEM[0], {grown(s) for s in shortest}, key=lambda s: (good[s], s))
    return (b" " + b" ".join(s.strip() for s in reversed(best)) + b" ")[-TOXIC_BYTES:] if best else b""


def ordinary_content(texts: list[list[bytes]]) -> bytes:
    samples = [w for words in texts for w in windows(words, 2 * WINDOW)][:: max(1, sum(map(len, texts)) // 400_000)]
    try:
        return zstandard.train_dictionary(ORDINARY_BYTES, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: the text itself
        return b"".join(samples)[-ORDINARY_BYTES:]


class Distance:
    """Savings of the toxic dictionary on windows and words."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.content = ordinary, toxic
        self.memo: dict[bytes, int] = {}
        p = zstandard.ZstdCompressionParameters.from_level(3, **PARAMETERS)
        self.plain, self.both = (self._compressor(p, c) for c in (ordinary, ordinary + toxic))

    @staticmethod
    def _compressor(p, content: bytes) -> zstandard.ZstdCompressor:
        if len(content) < 8:
            return zstandard.ZstdCompressor(compression_params=p)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        return zstandard.ZstdCompressor(compression_params=p, dict_data=d)

    def __reduce__(self):
        return Distance, self.content

    def saved(self, window: bytes) -> int:
        window += PAD
        return len(self.plain.compress(window)) - len(self.both.compress(window))

    def word(self, w: bytes) -> int:
        n = self.memo.get(w)
        if n is None:
            n = self.saved(b" " + w + b" ")
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            if len(w) <= 64:
                self.memo[w] = n
        return n

    def features(self, words: list[bytes]) -> list[float]:
        best, fine, hit = 0, [], 0
        for window in windows(words):
            n = self.saved(window)
            if n > 0:
                hit += 1
                best = max(best, n)
                for w in window.split():
                    if len(w) >= STEM[0] and (g := self.word(w)) > 0:
                        fine.append((g / (len(w) + 2), g))
        top = nlargest(3, fine)
        n = len(words) + 25
        return [top[0][0] if top else 0.0, sum(g for _, g in top) / 10, 20 * len(fine) / n,
                20 * sum(g >= 2 for _, g in fine) / n, min(best, 12) / 6, 30 * hit / n,
                float(sum(g >= 2 for _, g in top)) / 3, float(bool(fine)), float(sum(g >= 3 for _, g in top)) / 3]


class Model:
    def __init__(self, distance: Distance, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, bias: float) -> None:
        self.distance, self.mean, self.scale, self.w, self.bias = distance, mean, scale, w, bias

    def score(self, text: bytes) -> float:
        x = (np.array(self.distance.features(text.translate(WORDS).split())) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(x @ self.w + self.bias, -30, 30))))


def calibrate(X: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Weighted logistic regression by Newton steps with a small ridge."""
    mean, scale = X.mean(0), X.std(0) + 1e-6
    Z = np.hstack([(X - mean) / scale, np.ones((len(X), 1))])
    b = np.zeros(Z.shape[1])
    ridge = np.full(len(b), 1.0)
    ridge[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(Z @ b, -30, 30)))
        step = np.linalg.solve((Z * (weight * p * (1 - p))[:, None]).T @ Z + np.diag(ridge),
                               Z.T @ (weight * (y - p)) - ridge * b)
        b += np.clip(step, -2, 2)
    return mean, scale, b[:-1], float(b[-1])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """None if either class has no labelled document to learn from."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    rows = labelled_sample(spark, texts, labels, "toxic", sample_rows, each=True).limit(2 * sample_rows).collect()
    count = {r.toxic: r["count"] for r in labels.where("toxic IS NOT NULL").where(~held_out())
             .groupBy((F.col("toxic") >= 1).cast("int").alias("toxic")).count().collect()}
    texts = sorted((int(r.doc_id), bytes(r.text), int(r.label >= 1)) for r in rows)
    own = unlike([(t.translate(WORDS).split(), y) for _, t, y in texts])
    train, held = [x for k, x in enumerate(own) if k % 3], own[::3]
    cut = [[words for words, y in train if y == k] for k in (0, 1)]
    if not cut[0] or not cut[1]:
        return None
    distance = Distance(ordinary_content(cut[0]), toxic_content(cut[1], cut[0]))
    y = np.array([k for _, k in held], float)
    if not 0 < y.sum() < len(y):
        held, y = train, np.array([k for _, k in train], float)
    X = np.array([distance.features(words) for words, _ in held])
    # the sample takes the classes in equal parts; weights give back their shares
    share = count.get(1, 0) / max(1, sum(count.values()))
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(distance, *calibrate(X, y, weight))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document: doc_id, score (0 to 1, high: toxic).

    Null and empty texts have no window and get the score of a text that
    saves nothing. Every row is scored for itself, whatever its doc_id;
    other columns are no input. Without labelled documents of both classes
    every score is 0."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    model = fit(spark, docs, labels, sample_rows)
    if model is None:
        return own.select("doc_id", F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    def start():
        m = shared.value
        return lambda texts, part: {"doc_id": part.column("doc_id"), "score": list(map(m.score, texts))}

    return map_batches(own, "doc_id long, score double", start)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
