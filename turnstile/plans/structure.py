"""Queries on page structure whose truth SQL can tell: siblings alike (O94),
sources by page marks and their turn rules (O95, O90), groups between
separators (O44), formatted markup (O67-O79), nested placeholders (O34), the
quarantine (O13), the file sink (O06) and the aligned quality report (O96).

Pages are built from the given tables by a Spark job (``synth_pages`` or
here); the library's own code shreds, extracts and compares them."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from turnstile.functions.text import py_strip
from turnstile.operators.align import align, report
from turnstile.operators.extract import Options, extract, hr_group_turns, prepare, source_turns
from turnstile.operators.predicates import source_votes, winning_source
from turnstile.operators.protect import close_entries, make_key, restore
from turnstile.operators.render import render_markdown, typed_parts
from turnstile.operators.similarity import alike_siblings
from turnstile.plans.chat_documents import ORACLE as DOCUMENTS
from turnstile.plans.roundtrip import _PARITY
from turnstile.plans.synth_pages import chat_pages, esc, pages_of
from turnstile.session import ensure_checkpoint_dir
from turnstile.sources.documents import write_files
from turnstile.sources.tables import read_table

NL = "chr(10)"


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


# ---- O94 ----

def node_similarity(spark, sf_dir):
    """Pages whose turns are siblings with classes and child tags by
    their role, number and text; every two forms of them that are alike."""
    conv, turn, role = F.col("conv_id"), F.col("turn"), F.col("role")
    cls = (F.when(role == "user", F.lit("m user"))
           .when(role == "assistant", F.when(turn % 3 == 0, F.lit("m assistant wide dark tall lone")).otherwise(F.lit("m assistant"))))
    div = F.concat(
        F.lit('<div data-t="'), turn.cast("string"), F.lit('"'), F.coalesce(F.concat(F.lit(' class="'), cls, F.lit('"')), F.lit("")),
        F.lit("><p>"), esc(F.col("text")), F.lit("</p>"), F.repeat(F.lit("<p>x</p>"), F.length("text") % 5),
        F.repeat(F.lit("<ul></ul>"), ((conv + turn) % 3).cast("int")), F.repeat(F.lit("<b>t</b>"), (turn % 2).cast("int")),
        F.repeat(F.lit("<i></i>"), (conv % 2).cast("int")), F.lit("</div>"))
    g = (_conversations(spark, sf_dir).withColumn("div", div).groupBy("conv_id")
         .agg(F.expr("listagg(div, '') WITHIN GROUP (ORDER BY turn)").alias("divs")))
    pages = g.select(F.col("conv_id").alias("page_id"), F.lit("").alias("url"),
                     F.concat(F.lit("<html><body><main>"), F.col("divs"), F.lit("</main></body></html>")).alias("html"))
    m, *_ = prepare(pages, Options(raw=True))
    first = m.filter(F.col("kind") == "tag").select("page_id", "node_id", F.col("attrs")["data-t"].cast("long").alias("t"))
    side = lambda s: first.select("page_id", F.col("node_id").alias(s), F.col("t").alias(f"turn_{s}"))
    return (alike_siblings(m).join(side("a"), ["page_id", "a"]).join(side("b"), ["page_id", "b"])
            .select(F.col("page_id").alias("conv_id"), "turn_a", "turn_b", "n_a", "n_b", "jaccard", "edits"))


# ---- O95, O90 ----

TEMPLATE_OF = ("studio", "author", "elements")


def _three_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = [chat_pages(spark, sf_dir, t).filter(F.col("page_id") % 3 == k) for k, t in enumerate(TEMPLATE_OF)]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


def rt_source_votes(spark, sf_dir):
    """One table with pages of three sources; the marks on each tell its source."""
    pages = _three_sources(spark, sf_dir)
    m, *_ = prepare(pages, Options(raw=True))
    return winning_source(source_votes(m, pages)).withColumnRenamed("page_id", "conv_id")


def rt_three_sources(spark, sf_dir):
    """O95 -> O90: the same table, each page's turns read by its own source's rule."""
    t = source_turns(_three_sources(spark, sf_dir))
    return t.select(F.col("page_id").alias("conv_id"), "idx", "source", "role", py_strip(F.col("content")).alias("content"))


# ---- O44 ----

def rt_flux(spark, sf_dir):
    """One to four siblings between two separators are one turn."""
    t = hr_group_turns(chat_pages(spark, sf_dir, "flux"))
    return t.select(F.col("page_id").alias("conv_id"), "idx", "role", "confidence", py_strip(F.col("content")).alias("content"))


# ---- O67-O79, O79 off ----

def _markup(spark, sf_dir, tables: bool) -> DataFrame:
    ex = extract(chat_pages(spark, sf_dir, "markup"), Options(detector="heuristic", tables=tables))
    return ex.turns.select(F.col("page_id").alias("conv_id"), "idx", py_strip(F.col("content")).alias("content"))


def rt_markup(spark, sf_dir):
    """Nested lists, quotes in quotes, emphasis, code, breaks, images, links, rules, ragged tables."""
    return _markup(spark, sf_dir, True)


def rt_markup_no_tables(spark, sf_dir):
    """The same pages with tables as plain text."""
    return _markup(spark, sf_dir, False)


# ---- O64 ----

def rt_markup_parts(spark, sf_dir):
    """Typed parts of the same pages; images and tables among them."""
    ex = extract(chat_pages(spark, sf_dir, "markup"), Options(detector="heuristic"))
    p = typed_parts(ex.turns, ex.raw_content, ex.protected).filter(F.col("type") != "text")
    return p.select(F.col("page_id").alias("conv_id"), F.col("block_idx").alias("idx"), "pos", "type", "content", "language")


# ---- O71 ----

def rt_numbered(spark, sf_dir):
    """Each conversation as one ordered list, its items counted up."""
    g = (_conversations(spark, sf_dir).withColumn("li", F.concat(F.lit("<li>"), esc(F.col("text")), F.lit("</li>"))).groupBy("conv_id")
         .agg(F.expr("listagg(li, '') WITHIN GROUP (ORDER BY turn)").alias("items")))
    pages = g.select(F.col("conv_id").alias("page_id"), F.lit("").alias("url"), F.concat(
        F.lit("<html><body><ol>"), F.col("items"), F.lit("</ol></body></html>")).alias("html"))
    ex = extract(pages, Options(detector="heuristic", numbered=True))
    return ex.turns.groupBy(F.col("page_id").alias("conv_id")).agg(F.max(py_strip(F.col("content"))).alias("content"))


# ---- O34 ----

def restore_nested(spark, sf_dir):
    """Blocks that hold the key of the turn before, four deep, put back into the text."""
    c = _conversations(spark, sf_dir)
    key = lambda t: make_key("CODE", F.concat(F.col("conv_id").cast("string"), F.lit(":"), t.cast("string")))
    inner = F.when(F.col("turn") % 4 > 0, F.concat(F.lit(" <"), key(F.col("turn") - 1), F.lit(">"))).otherwise(F.lit(""))
    entries = c.select(F.col("conv_id").alias("page_id"), key(F.col("turn")).alias("key"),
                       F.concat("text", inner).alias("formatted"))
    turns = c.select(F.col("conv_id").alias("page_id"), F.col("turn").alias("block_idx"),
                     F.concat(F.lit("before "), key(F.col("turn")), F.lit(" behind")).alias("content"))
    done = restore(turns, close_entries(entries))
    return done.select(F.col("page_id").alias("conv_id"), F.col("block_idx").alias("turn"), "content")


# ---- O13 ----

MOST_NODES = 60


def quarantine_planted(spark, sf_dir):
    """Pages with up to 49 elements more and all they hold as one comment;
    those of more nodes than the limit reach the quarantine with their html."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", F.concat(
        F.repeat(F.lit("<b>x</b>"), (F.col("page_id") % 50).cast("int")), F.lit("<!--"),
        F.replace("html", F.lit("-"), F.lit("")), F.lit("-->")).alias("html"))
    ex = extract(pages, Options(detector="heuristic", max_nodes=MOST_NODES))
    return ex.quarantine.select("page_id", "stage", "error", F.sha2("html", 256).alias("html_sha256"))


# ---- O06 ----

def rt_files(spark, sf_dir):
    """A file for each page, written by the data source into the shared
    folder and read back by name."""
    ex = extract(chat_pages(spark, sf_dir, "data_attr"), Options(detector="heuristic"))
    docs = render_markdown(ex.turns.withColumn("content", py_strip(F.col("content"))))
    path = os.path.join(ensure_checkpoint_dir(spark), f"files-{uuid.uuid4().hex}")
    write_files(docs, path)
    back = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    return back.select(F.regexp_extract("name", r"^(\d+)\.md$", 1).cast("long").alias("conv_id"), F.col("value").alias("markdown"))


# ---- O96 ----

def quality_alignment(spark, sf_dir):
    """Some turns of each page are lost, some are there twice; found and
    true turns are aligned, and what doesn't match is listed."""
    c = _conversations(spark, sf_dir).filter(F.col("role").isin("user", "assistant"))
    r = (F.col("conv_id") + F.col("turn")) % 7
    given = c.filter(r != 3).withColumn("again", F.explode(F.sequence(F.lit(0), F.when(r == 5, 1).otherwise(0))))
    pages = pages_of(given.select("conv_id", (F.col("turn") * 2 + F.col("again")).alias("turn"), "role", "text"), "author")
    found = source_turns(pages).select(F.col("page_id").alias("conv_id"), "idx", py_strip(F.col("content")).alias("content"))
    truth = c.select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("idx"),
                     py_strip(F.col("text")).alias("content"))
    return report(align(found, truth))


_KIDS = "repeat('p', 1 + length(text) % 5) || repeat('u', (conv_id + turn) % 3) || repeat('b', turn % 2) || repeat('i', conv_id % 2)"


ORACLE = {
    "node_similarity": f"""
        WITH t AS (SELECT conv_id, turn, {_KIDS} AS kids,
                     CASE role WHEN 'user' THEN ['m', 'user']
                       WHEN 'assistant' THEN CASE WHEN turn % 3 = 0 THEN ['m', 'assistant', 'wide', 'dark', 'tall', 'lone']
                                                  ELSE ['m', 'assistant'] END ELSE [] END AS cls FROM conversations),
        f AS (SELECT conv_id, cls, kids, min(turn) AS t, count(*) AS n FROM t GROUP BY ALL),
        p AS (SELECT x.conv_id, x.t AS turn_a, y.t AS turn_b, x.n AS n_a, y.n AS n_b,
                CASE WHEN len(x.cls) + len(y.cls) = 0 THEN 1.0::DOUBLE
                  ELSE len(list_intersect(x.cls, y.cls))::DOUBLE / len(list_distinct(list_concat(x.cls, y.cls))) END AS jaccard,
                levenshtein(x.kids, y.kids) AS edits
              FROM f x JOIN f y ON x.conv_id = y.conv_id AND x.t < y.t)
        SELECT conv_id, turn_a, turn_b, n_a, n_b, round(jaccard, 6) AS jaccard, edits FROM p WHERE jaccard >= 0.3 AND edits <= 2""",
    "rt_source_votes": """
        SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'aistudio' WHEN 1 THEN 'chatgpt' ELSE 'gemini' END AS source,
          CASE conv_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 4
            ELSE 1 + 3 * max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) + 3 * max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) END AS votes
        FROM conversations GROUP BY conv_id""",
    "rt_three_sources": """
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx,
          CASE conv_id % 3 WHEN 0 THEN 'aistudio' WHEN 1 THEN 'chatgpt' ELSE 'gemini' END AS source,
          CASE conv_id % 3 WHEN 0 THEN CASE role WHEN 'user' THEN 'User' ELSE 'Model' END WHEN 1 THEN role
            ELSE CASE role WHEN 'user' THEN 'user-query' ELSE 'model-response' END END AS role, text AS content
        FROM conversations WHERE role IN ('user', 'assistant')""",
    "rt_flux": f"""
        SELECT conv_id, idx, role, confidence, content || CASE (conv_id + idx) % 4
          WHEN 0 THEN '' WHEN 1 THEN {NL} || 'second of ' || CAST(idx AS VARCHAR)
          WHEN 2 THEN {NL} || 'second of ' || CAST(idx AS VARCHAR) || {NL} || '- third'
          ELSE {NL} || 'second of ' || CAST(idx AS VARCHAR) || {NL} || '- third' || {NL} || {NL} || {NL} || 'fourth **'
               || CAST(conv_id AS VARCHAR) || '**' END AS content
        FROM ({_PARITY})""",
    "restore_nested": """
        WITH RECURSIVE c AS (SELECT conv_id, turn, text FROM conversations),
        e AS (SELECT conv_id, turn, text AS formatted FROM c WHERE turn % 4 = 0
              UNION ALL SELECT c.conv_id, c.turn, c.text || ' <' || e.formatted || '>'
              FROM e JOIN c ON c.conv_id = e.conv_id AND c.turn = e.turn + 1 AND c.turn % 4 > 0)
        SELECT conv_id, turn, 'before ' || formatted || ' behind' AS content FROM e""",
    "quarantine_planted": f"""
        SELECT page_id, 'shred' AS stage, 'more than {MOST_NODES} nodes' AS error,
          sha256(repeat('<b>x</b>', page_id % 50) || '<!--' || replace(html, '-', '') || '-->') AS html_sha256
        FROM pages WHERE 2 + 2 * (page_id % 50) > {MOST_NODES}""",
    "rt_files": f"SELECT conv_id, markdown FROM ({DOCUMENTS['rt_markdown']})",
    "quality_alignment": """
        WITH c AS (SELECT conv_id, turn, (conv_id + turn) % 7 AS r,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS true_idx
                   FROM conversations WHERE role IN ('user', 'assistant')),
        g AS (SELECT conv_id, r, true_idx, k, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS found_idx
              FROM (SELECT *, unnest(CASE WHEN r = 5 THEN [0, 1] ELSE [0] END) AS k FROM c WHERE r <> 3)),
        a AS (SELECT conv_id, true_idx AS i, 'lost' AS kind FROM c WHERE r = 3
              UNION ALL SELECT conv_id, CASE WHEN k = 1 THEN found_idx ELSE true_idx END, CASE WHEN k = 1 THEN 'extra' ELSE 'match' END FROM g)
        SELECT conv_id, count(*) FILTER (WHERE kind <> 'extra') AS n_true, count(*) FILTER (WHERE kind <> 'lost') AS n_found,
          count(*) FILTER (WHERE kind = 'match') AS n_match, count(*) FILTER (WHERE kind = 'lost') AS n_lost,
          count(*) FILTER (WHERE kind = 'extra') AS n_extra, CAST(0 AS BIGINT) AS n_changed,
          string_agg(kind || ' ' || CAST(i AS VARCHAR), ', ' ORDER BY i, kind) FILTER (WHERE kind <> 'match') AS warnings
        FROM a GROUP BY conv_id""",
}


def _markup_sql(table: str) -> str:
    t, c = "CAST(turn AS VARCHAR)", "CAST(conv_id AS VARCHAR)"
    lines = ["text", "''", f"'- one ' || {t}", "'- **two**'", "''", "''", "'1. x'", "''", "''", "'> outer'", f"'> > inner ' || {c}", "''",
             "'*em* `co`  '", "'after ![pic](/i.png) [link](/u)'", "''", "'---'", "''"]
    return (f"SELECT conv_id, turn AS idx, rtrim({f' || {NL} || '.join(lines)} || {NL} || {table}, {NL}) AS content FROM conversations")


ORACLE["rt_markup"] = _markup_sql(
    f"'| h1 | h2 |' || {NL} || '| --- | --- |' || {NL} || '| ' || CAST(turn AS VARCHAR) || ' |  |' || {NL} || '| a | b |'")
ORACLE["rt_markup_no_tables"] = _markup_sql("'h1h2' || CAST(turn AS VARCHAR) || 'a**b**c'")

ORACLE["rt_markup_parts"] = f"""
    SELECT conv_id, turn AS idx, 1 AS pos, 'image' AS type, '![pic](/i.png)' AS content, NULL::VARCHAR AS language FROM conversations
    UNION ALL
    SELECT conv_id, turn, 3, 'table', '| h1 | h2 |' || {NL} || '| --- | --- |' || {NL} || '| ' || CAST(turn AS VARCHAR)
           || ' |  |' || {NL} || '| a | b |', NULL FROM conversations"""
ORACLE["rt_numbered"] = f"""
    SELECT conv_id, string_agg(CAST(k AS VARCHAR) || '. ' || text, {NL} ORDER BY k) AS content
    FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY conv_id"""

QUERIES = {f.__name__: f for f in (
    node_similarity, rt_source_votes, rt_three_sources, rt_flux, rt_markup, rt_markup_no_tables, rt_markup_parts, rt_numbered,
    restore_nested, quarantine_planted, rt_files, quality_alignment)}
