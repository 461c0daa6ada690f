"""Round-trip queries: conversations -> chat pages -> extraction -> turns,
compared with SQL over ``conversations`` (O28-O34, O39-O50, O58-O64, O78).

Each query runs the full extraction over all conversations of the table.
Text columns are compared stripped (leading/trailing whitespace removed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnstile.functions.text import py_strip
from turnstile.operators.extract import Options, extract
from turnstile.operators.render import typed_parts
from turnstile.plans.conversations import ORACLE as CONV_ORACLE
from turnstile.plans.synth_pages import NAV_MD, chat_pages
from turnstile.sources.tables import read_table


def _turns(spark: SparkSession, sf_dir: str, template: str, detector: str) -> DataFrame:
    ex = extract(chat_pages(spark, sf_dir, template), Options(detector=detector))
    return ex.turns.select(F.col("page_id").alias("conv_id"), "idx", "role", "confidence",
                           py_strip(F.col("content")).alias("content"))


def rt_data_attr(spark, sf_dir):
    """Template data_attr, forced rule probes: every turn, roles from classes."""
    return _turns(spark, sf_dir, "data_attr", "heuristic")


def rt_semantic_class(spark, sf_dir):
    """Template semantic, forced rule probes: system turns match no class
    pattern and drop out; a page with fewer than two user/assistant turns
    falls back to its whole body."""
    return _turns(spark, sf_dir, "semantic", "heuristic")


def rt_hr(spark, sf_dir):
    """Template separator, forced rule probes: roles by alternation only."""
    return _turns(spark, sf_dir, "separator", "heuristic")


def rt_topology(spark, sf_dir):
    """Template topology, forced clustering: the deepest repeated level wins."""
    return _turns(spark, sf_dir, "topology", "topo")


def rt_signature(spark, sf_dir):
    """Template topology with the signature-cluster detector (O53-O57): the
    message wrappers share parent and signature and win."""
    return _turns(spark, sf_dir, "topology", "signature")


def rt_regroup(spark, sf_dir):
    """O97 on the data-attribute pages with the clustering detector: the
    winning cluster holds fragments of messages, which are regrouped per
    message anchor. Rows only: which fragments win depends on the page
    (tested on a fixture in tests/test_extract.py)."""
    from turnstile.operators.extract import regroup
    ex = extract(chat_pages(spark, sf_dir, "data_attr"), Options(detector="topo"))
    r = regroup(ex)
    return r.select(F.col("page_id").alias("conv_id"), "idx", "role", "confidence",
                    py_strip(F.col("content")).alias("content"))


def rt_source_rule(spark, sf_dir):
    """Studio-style pages read by the per-source rule; system turns are
    not kept by the rule."""
    from turnstile.operators.extract import source_turns
    t = source_turns(chat_pages(spark, sf_dir, "studio"))
    return t.select(F.col("page_id").alias("conv_id"), "idx", "role", py_strip(F.col("content")).alias("content"))


def legacy_code(spark, sf_dir):
    """O36 on the data-attribute pages: the planted code blocks in the
    monolith's fence format (no space after the fence)."""
    from turnstile.operators.extract import Options as _O, prepare
    from turnstile.operators.legacy import legacy_code_blocks
    m, *_ = prepare(chat_pages(spark, sf_dir, "data_attr"), _O(raw=True))
    return legacy_code_blocks(m).select(F.col("page_id").alias("conv_id"), "kind", "lang", "formatted")


def rt_hr_groups(spark, sf_dir):
    """The separator pages read as groups between ``hr`` separators."""
    from turnstile.operators.extract import hr_group_turns
    t = hr_group_turns(chat_pages(spark, sf_dir, "separator"))
    return t.select(F.col("page_id").alias("conv_id"), "idx", "role", "confidence",
                    py_strip(F.col("content")).alias("content"))


def rt_clean_text(spark, sf_dir):
    """Clean text of each detected turn block on the separator pages."""
    from turnstile.operators.extract import clean_text
    ex = extract(chat_pages(spark, sf_dir, "separator"), Options(detector="heuristic"))
    c = clean_text(ex.metrics, ex.turns.select("page_id", "node_id"))
    return (ex.turns.join(c, ["page_id", "node_id"])
            .select(F.col("page_id").alias("conv_id"), "idx", "clean_text"))


def protect_keys(spark, sf_dir):
    """The placeholder map of the planted blocks."""
    ex = extract(chat_pages(spark, sf_dir, "data_attr"), Options(detector="heuristic"))
    return ex.protected.select(F.col("page_id").alias("conv_id"), "ptype", "raw", "key")


def table_gfm(spark, sf_dir):
    """Nations of each region rendered as an HTML table (a 3-column
    header over 2-cell rows, so rows are padded), converted back to GFM."""
    n = read_table(spark, sf_dir, "nation")
    row = F.concat(F.lit("<tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td>"),
                   F.col("n_name"), F.lit("</td></tr>"))
    g = n.withColumn("r", row).groupBy("n_regionkey").agg(
        F.expr("listagg(r, '') WITHIN GROUP (ORDER BY n_nationkey)").alias("rows"))
    html = F.concat(F.lit("<html><body><table><tr><th>key</th><th>name</th><th>note</th></tr>"),
                    F.col("rows"), F.lit("</table></body></html>"))
    pages = g.select(F.col("n_regionkey").cast("long").alias("page_id"), F.lit("").alias("url"),
                     html.alias("html"))
    ex = extract(pages, Options(detector="heuristic"))
    return ex.turns.select(F.col("page_id").alias("n_regionkey"),
                           py_strip(F.col("content")).alias("gfm"))


def rt_parts(spark, sf_dir):
    """Typed parts of each turn (text / code / mermaid / math_inline), and the language of code."""
    ex = extract(chat_pages(spark, sf_dir, "data_attr"), Options(detector="heuristic"))
    p = typed_parts(ex.turns, ex.raw_content, ex.protected)
    return p.select(F.col("page_id").alias("conv_id"), F.col("block_idx").alias("idx"), "pos", "type",
                    "content", "language")


def quality_report(spark, sf_dir):
    """Extracted turns against the truth, per conversation (full outer
    join on (conv_id, turn)): turns expected, found, detected with their
    text, roles right, mean confidence."""
    ext = rt_data_attr(spark, sf_dir).withColumnRenamed("idx", "turn")
    truth = read_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "assistant", "model").otherwise(F.col("role")).alias("true_role"),
        "text")
    j = truth.join(ext, ["conv_id", "turn"], "full_outer")
    return j.groupBy("conv_id").agg(
        F.count("text").alias("n_true"), F.count("content").alias("n_found"),
        F.sum(F.coalesce(F.col("content").startswith(F.col("text")), F.lit(False)).cast("int")).alias("n_detected"),
        F.sum(F.coalesce(F.col("role") == F.col("true_role"), F.lit(False)).cast("int")).alias("n_role_ok"),
        F.round(F.avg("confidence"), 6).alias("mean_conf"))


NL = "chr(10)"
_PLANT_SQL = """
  (CASE WHEN role <> 'assistant' THEN NULL
        WHEN substr(md5(CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)), 1, 1)
             IN ('0','1','2','3') THEN 'code'
        WHEN substr(md5(CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)), 1, 1)
             IN ('4','5','6','7') THEN 'mermaid'
        WHEN substr(md5(CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)), 1, 1)
             IN ('8','9','a','b') THEN 'math' END)"""
_RAW_SQL = f"""
  (CASE kind WHEN 'code' THEN 'print(' || CAST(conv_id AS VARCHAR) || ', ' || CAST(turn AS VARCHAR) || ')'
             WHEN 'mermaid' THEN 'graph TD' || {NL} || '  A[Turn ' || CAST(turn AS VARCHAR) || '] --> B[Conv '
                                 || CAST(conv_id AS VARCHAR) || ']'
             WHEN 'math' THEN 'x^' || CAST(turn AS VARCHAR) || ' + ' || CAST(conv_id AS VARCHAR) END)"""
_PLANT_MD_SQL = f"""
  (CASE kind WHEN 'code' THEN {NL} || '``` python' || {NL} || raw || {NL} || '```'
             WHEN 'mermaid' THEN {NL} || '```mermaid' || {NL} || raw || {NL} || '```'
             WHEN 'math' THEN {NL} || {NL} || 'Formula $' || raw || '$ here.'
             ELSE '' END)"""
_PLANTED = f"""
  (SELECT conv_id, turn, role, text, kind, {_RAW_SQL} AS raw
   FROM (SELECT *, {_PLANT_SQL} AS kind FROM conversations))"""
_PARITY = """
  SELECT conv_id, turn AS idx, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'model' END AS role,
         CASE WHEN turn = 0 THEN 0.4 ELSE 0.5 END::DOUBLE AS confidence, text AS content
  FROM conversations"""

ORACLE = {
    "rt_data_attr": f"""
        WITH r AS ({CONV_ORACLE['role_alternation']}), p AS {_PLANTED}
        SELECT p.conv_id, p.turn AS idx, r.inferred_role AS role, r.confidence,
               p.text || {_PLANT_MD_SQL} AS content
        FROM p JOIN r ON p.conv_id = r.conv_id AND p.turn = r.turn""",
    "rt_semantic_class": f"""
        WITH p AS {_PLANTED},
        ua AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx,
                      count(*) OVER (PARTITION BY conv_id) AS n_ua
               FROM p WHERE role IN ('user', 'assistant')),
        few AS (SELECT conv_id FROM p GROUP BY conv_id
                HAVING sum(CASE WHEN role IN ('user', 'assistant') THEN 1 ELSE 0 END) < 2)
        SELECT conv_id, idx, CASE WHEN role = 'user' THEN 'user' ELSE 'model' END AS role,
               0.8::DOUBLE AS confidence, text || {_PLANT_MD_SQL} AS content
        FROM ua WHERE n_ua >= 2
        UNION ALL
        SELECT conv_id, 0 AS idx, 'user' AS role, 0.4::DOUBLE AS confidence,
               rtrim('{NAV_MD}' || string_agg({NL} || text || {NL}, '' ORDER BY turn), {NL}) AS content
        FROM p WHERE conv_id IN (SELECT conv_id FROM few) GROUP BY conv_id""",
    "rt_hr": _PARITY,
    "rt_topology": _PARITY,
    "rt_signature": _PARITY,
    "rt_hr_groups": _PARITY,
    "rt_clean_text": "SELECT conv_id, turn AS idx, trim(text) AS clean_text FROM conversations",
    "protect_keys": f"""
        SELECT conv_id, kind AS ptype, raw,
               '__TSK_' || CASE kind WHEN 'code' THEN 'CODE' WHEN 'mermaid' THEN 'MERM' ELSE 'MATH' END
               || '_' || substr(md5(raw), 1, 16) || '__' AS key
        FROM {_PLANTED} WHERE kind IS NOT NULL""",
    "table_gfm": f"""
        SELECT n_regionkey,
               '| key | name | note |' || {NL} || '| --- | --- | --- |' || {NL}
               || string_agg('| ' || CAST(n_nationkey AS VARCHAR) || ' | ' || n_name || ' |  |', {NL}
                             ORDER BY n_nationkey) AS gfm
        FROM nation GROUP BY n_regionkey""",
}

ORACLE["rt_source_rule"] = """
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx,
           CASE WHEN role = 'user' THEN 'User' ELSE 'Model' END AS role, text AS content
    FROM conversations WHERE role IN ('user', 'assistant')"""
ORACLE["legacy_code"] = f"""
    SELECT conv_id, 'code' AS kind, 'python' AS lang, '```python' || {NL} || raw || {NL} || '```' AS formatted
    FROM {_PLANTED} WHERE kind = 'code'"""
ORACLE["rt_parts"] = f"""
    WITH p AS {_PLANTED}
    SELECT conv_id, turn AS idx, 0 AS pos, 'text' AS type,
           CASE WHEN kind = 'math' THEN text || {NL} || {NL} || 'Formula' ELSE text END AS content, NULL::VARCHAR AS language FROM p
    UNION ALL
    SELECT conv_id, turn, 1, CASE WHEN kind = 'math' THEN 'math_inline' ELSE kind END,
           CASE kind WHEN 'code' THEN '``` python' || {NL} || raw || {NL} || '```'
                     WHEN 'mermaid' THEN '```mermaid' || {NL} || raw || {NL} || '```'
                     ELSE '$' || raw || '$' END,
           CASE kind WHEN 'code' THEN 'python' WHEN 'mermaid' THEN 'mermaid' END
    FROM p WHERE kind IS NOT NULL
    UNION ALL
    SELECT conv_id, turn, 2, 'text', 'here.', NULL FROM p WHERE kind = 'math'"""
ORACLE["quality_report"] = f"""
    WITH r AS ({CONV_ORACLE['role_alternation']})
    SELECT c.conv_id, count(*) AS n_true, count(*) AS n_found, count(*) AS n_detected,
           sum(CASE WHEN r.inferred_role = (CASE WHEN c.role = 'assistant' THEN 'model' ELSE c.role END)
                    THEN 1 ELSE 0 END) AS n_role_ok,
           round(avg(r.confidence), 6) AS mean_conf
    FROM conversations c JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn
    GROUP BY c.conv_id"""

QUERIES = {
    "rt_parts": rt_parts,
    "quality_report": quality_report,
    "rt_data_attr": rt_data_attr,
    "rt_semantic_class": rt_semantic_class,
    "rt_hr": rt_hr,
    "rt_topology": rt_topology,
    "rt_signature": rt_signature,
    "rt_hr_groups": rt_hr_groups,
    "rt_clean_text": rt_clean_text,
    "legacy_code": legacy_code,
    "rt_source_rule": rt_source_rule,
    "rt_regroup": rt_regroup,
    "protect_keys": protect_keys,
    "table_gfm": table_gfm,
}
