"""Target-distribution importance resampling: documents are drawn by how much
likelier their words are in a target table than in the corpus.

Features are runs of up to ``max_run`` consecutive words, and a feature's
bucket is its crc32 modulo ``buckets``. Texts are scanned a slice at a time:
the slice's distinct words, each with a delimiter on both sides, are the
dictionary of an Aho-Corasick automaton, whose payload for a word is its crc
and its length. A match is a whole word, as no delimiter is inside one and
two words share the delimiter between them. The automaton's scan of the
slice gives the payloads in order, and those of adjacent words are composed:
the crc of a run follows from the crcs and lengths of its words alone, so
no run is ever built as a string.

Texts are scanned once; their buckets are written and read again for the
counts and for the scores. Counts come back by bucket (their number is a
parameter, not the data's). Scores are integers within a range that the
buckets' gains and the noise bound, so a count by score gives each score's
first rank, and ranks within a score come from a window over it; only rows
that may be drawn are shuffled.
"""

from __future__ import annotations

import math
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from turnstile.llm.common import WORDS, checkpoint, map_batches, read_table, text_bytes

BUCKETS = 10_000
MAX_RUN = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
SPACE = crc32(b" ")


# -- crcs of runs from the crcs of their words

class Shift:
    """What a crc32 becomes when zero bytes follow: a linear map, so one table
    of 4 x 256 for each power of two of their number."""

    def __init__(self) -> None:
        one = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            one = (one >> 1) ^ np.where(one & 1, np.uint32(0xEDB88320), np.uint32(0))
        self._byte = one
        self.tables = [self._table(lambda c: (c >> 8) ^ self._byte[c & 255])]

    @staticmethod
    def _table(step) -> np.ndarray:
        return np.array([step(np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)])

    @staticmethod
    def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]

    def __call__(self, crc: np.ndarray, size: np.ndarray) -> np.ndarray:
        crc, size, k = crc.copy(), size.copy(), 0
        while size.any():
            if k == len(self.tables):
                last = self.tables[-1]
                self.tables.append(self._table(lambda c: self._apply(last, self._apply(last, c))))
            odd = (size & 1) == 1
            crc[odd] = self._apply(self.tables[k], crc[odd])
            size >>= 1
            k += 1
        return crc


SHIFT = Shift()


def composed(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of ``left + b" " + right`` from the crcs of both and the size of ``right``."""
    spaced = SHIFT(left, np.ones(len(left), np.int64)) ^ np.uint32(SPACE)
    return SHIFT(spaced, size) ^ right


def payloads(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """crc and length of every word of the texts, in order, and the number of
    words of each text."""
    marked = [t.translate(WORDS).split() for t in texts]
    counts = np.array([len(w) for w in marked], np.int64)
    automaton = ahocorasick.Automaton()
    for word in set().union(*marked):
        # one character for each byte
        automaton.add_word(f" {word.decode('latin-1')} ", crc32(word) << 31 | min(len(word), 2 ** 31 - 1))
    if not len(automaton):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), counts
    automaton.make_automaton()
    emitted = []
    for words in marked:
        if words:
            line = f" {b' '.join(words).decode('latin-1')} "
            emitted.append(np.fromiter((p for _, p in automaton.iter(line)), np.int64, len(words)))
    flat = np.concatenate(emitted)
    return (flat >> 31).astype(np.uint32), flat & (2 ** 31 - 1), counts


def buckets_of(texts: list[bytes], max_run: int = MAX_RUN, buckets: int = BUCKETS) -> tuple[list[np.ndarray], np.ndarray]:
    """Per text the buckets of its features (those of single words first, then
    of longer runs), and its number of words."""
    crc, size, counts = payloads(texts)
    text = np.repeat(np.arange(len(texts)), counts)
    found, owner, run = [crc % np.uint32(buckets)], [text], crc
    for n in range(1, max_run):
        if len(crc) <= n:
            break
        run = composed(run[:-1], crc[n:], size[n:])  # one word more behind each run
        whole = text[n:] == text[:-n]
        found.append(run[whole] % np.uint32(buckets))
        owner.append(text[n:][whole])
    flat, of = np.concatenate(found).astype(np.int32), np.concatenate(owner)
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=len(texts)))
    return np.split(flat[order], ends[:-1]), counts


# -- on Spark

def features(docs: DataFrame, id_column: str | None = None, max_run: int = MAX_RUN, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, buckets (array of int) of each row of ``docs``, written
    to the checkpoint folder."""
    own = F.col(f"`{id_column}`").cast("long") if id_column else F.lit(None).cast("long")

    def start():
        def work(texts, part):
            found, counts = buckets_of(texts, max_run, buckets)
            ends = np.cumsum([0] + [len(f) for f in found]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            return {"doc_id": part.column("doc_id"), "n_words": pa.array(counts),
                    "buckets": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))}
        return work

    return checkpoint(map_batches(docs.select(own.alias("doc_id"), text_bytes().alias("text")),
                                  "doc_id long, n_words long, buckets array<int>", start))


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows: summed in each task, then by
    bucket. What comes back is bounded by the number of buckets."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("buckets").flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket ``floor(1000 * ln(ratio of smoothed shares))``."""
    add = len(corpus)
    every, every_target = float(corpus.sum() + add), float(target.sum() + add)
    return np.array([math.floor(1000 * math.log((t + 1.0) * every / ((s + 1.0) * every_target)))
                     for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean gain (no features: 0)."""

    def run(batches):
        for batch in batches:
            lists = batch.column("buckets")
            ends = lists.offsets.to_numpy().astype(np.int64)
            total = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy(zero_copy_only=False)])])
            n = np.diff(ends)
            ends = ends - ends[0]
            weight = (total[ends[1:]] - total[ends[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(n), pa.array(weight)],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: str = SEED):
    """Gumbel noise in thousandths from a hash of seed and id."""
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, drawable, percent: int) -> DataFrame:
    """``scored`` (doc_id, score, ...) with rank: 1, 2, ... over the
    ``percent`` of the rows with ``drawable`` that have the highest scores,
    ties to the smaller doc_id (null ids last); null elsewhere."""
    spark = scored.sparkSession
    # scores are integers in a bounded range, so the counts are few
    held = sorted(((r.score, r["count"]) for r in scored.where(drawable).groupBy("score").count().collect()), reverse=True)
    draw, before, first = sum(n for _, n in held) * percent // 100, 0, []
    for score, n in held:
        if before >= draw:
            break
        first.append((score, before))
        before += n
    none = scored.withColumn("rank", F.lit(None).cast("long"))
    if not first:
        return none
    may = F.coalesce(drawable & (F.col("score") >= first[-1][0]), F.lit(False))
    starts = F.broadcast(spark.createDataFrame(first, "score long, before long"))
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last())
    rank = (F.col("before") + F.row_number().over(order)).cast("long")
    drawn = (scored.where(may).join(starts, "score").withColumn("rank", rank)
             .withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))))
    return drawn.select(*none.columns).unionByName(none.where(~may))


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, max_run: int = MAX_RUN, buckets: int = BUCKETS,
             least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED, id_column: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_features, weight, score, rank.

    Null and empty texts have no words, weight 0 and no rank. Rows that
    repeat an id count and are drawn each, with one noise; a null id has the
    noise of an empty one and comes last among equals. An empty table gives
    no rows, an empty target a share of nothing to every bucket. Texts of any
    length are scanned whole; other columns are ignored."""
    corpus = features(docs, id_column, max_run, buckets)
    wanted = features(target, None, max_run, buckets)
    gain = gains(bucket_counts(corpus, buckets), bucket_counts(wanted, buckets))
    scored = checkpoint(weighted(corpus, gain).withColumn("score", F.col("weight") + noise(seed)))
    return ranked(scored, F.col("n_words") >= least_words, percent)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: By definition; crc32 byte by byte with its table made in SQL.
OP13_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT unnest({_WORDS}) AS x FROM benchmark),
tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, k: xor(c >> 1, CASE WHEN (c & 1) = 1 THEN 3988292384 ELSE 0 END)) AS c FROM (SELECT unnest(range(256)) AS i))),
dx AS MATERIALIZED (SELECT r, unnest(w) AS x FROM d),
u AS (SELECT DISTINCT x FROM (SELECT x FROM dx UNION ALL SELECT x FROM b)),
crc AS MATERIALIZED (SELECT x, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(x)), '..'),
    lambda h: CAST('0x' || h AS BIGINT))), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM u, tab),
s AS (SELECT bucket, count(*) AS s FROM dx JOIN crc USING (x) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN crc USING (x) GROUP BY bucket),
g AS MATERIALIZED (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM dx) + {BUCKETS})
    / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM b) + {BUCKETS})))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
m AS (SELECT r, CAST(sum(gain) AS BIGINT) AS total FROM dx JOIN crc USING (x) JOIN g USING (bucket) GROUP BY r),
f AS (SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(CAST(floor(total::DOUBLE / len(w)) AS BIGINT), 0) AS weight,
    CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m ON m.r = d.r),
k AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM f),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () * {PERCENT} // 100 AS draw
      FROM k WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= draw THEN rank END AS rank FROM k LEFT JOIN o USING (r)
"""
