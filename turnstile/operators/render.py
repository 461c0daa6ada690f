"""Documents from ordered turns.

``turns(page_id, idx, role, confidence, content)`` -> one row per page.
Markdown: ``## User`` / ``## MODEL`` headers, the content, a ``---`` rule,
then one left-to-right pass turning three newlines into two. JSON keeps
non-ASCII text and nulls; the YAML form is the same document without
confidence (JSON is valid YAML 1.2). Session ids are deterministic.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from turnstile.functions.text import fmt2, preview, squeeze_once
from turnstile.operators.protect import KEY_PATTERN

DEFAULT_TITLE = "Chat export"
#: Column of a document by its format.
DOCUMENT_COLUMN = {"md": "markdown", "json": "json"}


def _ordered(col: str, order: str = "idx") -> Column:
    return F.expr(f"listagg({col}, '') WITHIN GROUP (ORDER BY {order})")


def render_markdown(turns: DataFrame, frontmatter: bool = False, title: str = DEFAULT_TITLE,
                    date: str = "1970-01-01T00:00:00") -> DataFrame:
    label = F.when(F.col("role") == "user", F.lit("User")).otherwise(F.lit("MODEL"))
    t = turns.withColumn("piece", F.concat(F.lit("## "), label, F.lit("\n\n"), F.col("content"),
                                           F.lit("\n"), F.lit("\n---\n\n")))
    g = t.groupBy("page_id").agg(F.count("*").alias("n_turns"), _ordered("piece").alias("body"))
    doc = F.col("body")
    if frontmatter:
        doc = F.concat(F.lit(f"---\ntitle: {title}\ndate: {date}\nturns_count: "),
                       F.col("n_turns").cast("string"), F.lit("\n---\n\n"), doc)
    return g.select("page_id", "n_turns", squeeze_once(doc).alias("markdown"))


def _session(turns: DataFrame, with_confidence: bool, id_col: Column) -> DataFrame:
    fields = [F.col("idx").alias("index"), F.col("role")]
    if with_confidence:
        fields.append(F.col("confidence"))
    fields.append(F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("content")))
                  .alias("content"))
    g = turns.groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.struct("idx", F.struct(*fields).alias("t")))).alias("ts"),
        F.first(id_col).alias("sid"))
    return g.select("page_id", F.struct(F.struct(F.col("sid").alias("id"),
                                                 F.transform("ts", lambda x: x["t"]).alias("turns"))
                                        .alias("session")).alias("doc"))


def render_json(turns: DataFrame, with_confidence: bool = True) -> DataFrame:
    """O07 (and O08 with ``with_confidence=False``)."""
    sid = F.md5(F.col("page_id").cast("string"))
    s = _session(turns, with_confidence, sid)
    return s.select("page_id", F.to_json("doc", {"ignoreNullFields": "false"}).alias("json"))


# Tables and images as the Markdown conversion writes them.
TABLE = r"(?<=^|\n)\|[^\n]*\|\n\|(?: --- \|)+(?:\n\|[^\n]*\|)*"
IMAGE = r"!\[[^\]\n]*\]\([^)\n]*\)"


def typed_parts(turns: DataFrame, raw_content: DataFrame, protected: DataFrame) -> DataFrame:
    """Split each turn at its placeholders, tables and images, in order
    (``pos``, from 0, among a turn's parts): text, code, mermaid, math_inline,
    math_block, table or image, with the language of code. Empty text is no part."""
    cut = f"{KEY_PATTERN}|{TABLE}|{IMAGE}"
    segs = raw_content.select("page_id", "block_idx", F.split("content", cut).alias("segs"),
                              F.regexp_extract_all("content", F.lit(f"({cut})"), 1).alias("ks"))
    text = F.regexp_replace("s", r"(?U)^\s+|\s+$", "")
    none = F.lit(None).cast("string")
    txt = segs.select("page_id", "block_idx", F.posexplode("segs").alias("i", "s")).select(
        "page_id", "block_idx", (F.col("i") * 2).alias("at"), F.lit("text").alias("type"), text.alias("content"),
        none.alias("language")).filter(F.col("content") != "")
    ks = segs.select("page_id", "block_idx", F.posexplode("ks").alias("i", "key")).join(
        protected.hint("merge"), ["page_id", "key"], "left")
    typ = (F.when(F.col("ptype") == "math", F.when(F.col("formatted").startswith("$$"), "math_block")
                  .otherwise("math_inline"))
           .otherwise(F.coalesce("ptype", F.when(F.col("key").startswith("|"), "table")
                                 .when(F.col("key").startswith("!["), "image").otherwise("text"))))
    keys = ks.select("page_id", "block_idx", (F.col("i") * 2 + 1).alias("at"), typ.alias("type"),
                     F.coalesce("formatted", "key").alias("content"), F.nullif("language", F.lit("")).alias("language"))
    w = Window.partitionBy("page_id", "block_idx").orderBy("at")
    return (txt.unionByName(keys).withColumn("pos", F.row_number().over(w) - 1)
            .select("page_id", "block_idx", "pos", "type", "content", "language"))


def render_report(turns: DataFrame, date: str, version: str, fmt: str = "md") -> DataFrame:
    """Header facts, then for each turn its role, confidence and the
    first 120 characters."""
    line = F.concat(F.lit("### Turn "), F.col("idx").cast("string"), F.lit(" - "), F.col("role"),
                    F.lit(" (confidence: "), fmt2(F.col("confidence")), F.lit(")\n> "),
                    preview(F.col("content")), F.lit("\n\n"))
    g = turns.withColumn("line", line).groupBy("page_id").agg(F.count("*").alias("n"), _ordered("line").alias("lines"))
    head = F.concat(F.lit("# Extraction report - "), F.col("page_id").cast("string"),
                    F.lit(f"\n\n- **Date**: {date}\n- **Status**: SUCCESS\n- **Version**: {version}\n"
                          f"- **Format**: {fmt}\n- **Turns**: "), F.col("n").cast("string"))
    return g.select("page_id", F.concat(head, F.lit("\n\n## Turns\n\n"), F.col("lines")).alias("report"))


def write_documents(docs: DataFrame, path: str, fmt: str = "md") -> None:
    """One document per page. Each task writes the pages that it has to
    one file, so the files are as many as the tasks, and no page moves."""
    docs.select("page_id", DOCUMENT_COLUMN[fmt]).write.mode("overwrite").parquet(os.path.join(path, fmt))


def read_documents(spark: SparkSession, path: str, fmt: str = "md") -> DataFrame:
    """What ``write_documents`` wrote: page_id and the document's column."""
    return spark.read.parquet(os.path.join(path, fmt))
