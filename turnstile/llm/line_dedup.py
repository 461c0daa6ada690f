"""Line dedup: explode normalised lines, hash, count documents per hash, drop
the lines over the threshold, reassemble by position. DataFrame functions
only.

Plan. (1) Each document's distinct line keys are hashed and exploded; one
aggregate per hash counts documents and takes the largest doc_id. Hashes
only are shuffled, summed before the shuffle. (2) Lines are exploded again
with their position, as hashes, and joined to the hashes at or over the
threshold; what is left is the positions to drop. (3) Each document joins
its own drop positions and keeps what lies between them. A line that a third
of the documents hold is one row after step 1; in step 2 it is a skewed key
of a plain equi-join, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnstile.llm.common import boxed, read_table, unboxed

MIN_CHARS = 20
MIN_DOCS = 3

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keys_of(lines: Column, min_chars: int) -> Column:
    """Stripped lines with A-Z lower-cased; null for those that are too short
    to count. One step after the other, as each is computed once that way;
    ``lower`` is the same for ASCII and much faster."""
    bare = F.transform(lines, lambda x: F.btrim(x, F.lit(BLANK)))
    return F.transform(bare, lambda x: F.when(F.length(x) < min_chars, F.lit(None)).otherwise(
        F.when(F.length(x) == F.octet_length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))))


def _hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per document: doc_id, row key, 128-bit hash of each line's key
    from two seeds (null: too short)."""
    keys = keys_of(lines_of(F.col("text")), min_chars)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"),
        F.transform(keys, lambda k: F.when(k.isNotNull(), F.struct(
            F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b")))).alias("h"))


# The outer forms of explode: for the others Spark filters on the array's size before, which computes it twice.

def repeated(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Keys found in ``min_docs`` documents or more: a, b (hash), n_docs, last_doc."""
    own = (_hashes(docs, min_chars).select("doc_id", F.explode_outer(F.array_distinct("h")).alias("k"))
           .where(F.col("k").isNotNull()))
    return (own.groupBy("k.a", "k.b").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
            .where(F.col("n_docs") >= min_docs))


def drops(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Positions (from 0) to drop, sorted, for each (doc_id, t) that loses lines."""
    lines = (_hashes(docs, min_chars).select("doc_id", "t", F.posexplode_outer("h").alias("pos", "k"))
             .where(F.col("k").isNotNull()).select("doc_id", "t", "pos", "k.a", "k.b"))
    lost = (lines.join(repeated(docs, min_chars, min_docs).select("a", "b", "last_doc"), ["a", "b"])
            .where(~F.col("doc_id").eqNullSafe(F.col("last_doc"))))
    return lost.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set("pos")).alias("drop"))


def kept_text(lines: Column, drop: Column) -> Column:
    """Lines that lie between the dropped positions, joined by newlines; one
    pass over the lines, however many are dropped."""
    ends = F.concat(drop, F.array(F.size(lines)))
    runs = F.transform(ends, lambda e, i: F.slice(
        lines, F.when(i == 0, F.lit(1)).otherwise(F.try_element_at(drop, i) + 2),
        e - F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(drop, i) + 1)))
    return F.array_join(F.flatten(runs), "\n")


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with columns n_lines, n_dropped and kept (the text that stays).

    A row is a document, so rows that repeat a doc_id count one each, and all
    rows with a key's largest doc_id keep its lines; a null doc_id is smaller
    than any other, and if only such rows hold a key all keep it. Null and
    empty texts are one empty line and give an empty ``kept``. Columns of
    ``docs`` that are named like those made here are replaced."""
    cut = drops(docs, min_chars, min_docs).select(
        F.col("doc_id").alias("_doc"), F.col("t").alias("_t"), F.col("drop").alias("_drop"))
    both = boxed(docs, F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("t"))
    both = both.join(cut, F.col("id").eqNullSafe(F.col("_doc")) & (F.col("t") == F.col("_t")), "left")
    text = both["row"].getField("text")
    lines = lines_of(text)
    return unboxed(
        both, docs.columns, n_lines=F.size(lines).cast("long"), n_dropped=F.coalesce(F.size("_drop"), F.lit(0)).cast("long"),
        kept=F.when(F.col("_drop").isNull(), F.coalesce(text, F.lit(""))).otherwise(kept_text(lines, F.col("_drop"))))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line,
        translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20
        GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, hot.key IS NOT NULL AND k.doc_id <> hot.last_doc AS gone FROM k LEFT JOIN hot ON k.key = hot.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
