"""Pages to documents, and the automatic strategy (O06-O08, O58, O59, O65,
O81, O82, O85): chat pages built from ``conversations`` are extracted, and
what ``operators.render`` makes of the turns is compared with SQL over
``conversations``."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnstile.functions.text import py_strip
from turnstile.operators.extract import Options, extract
from turnstile.operators.render import read_documents, render_json, render_markdown, render_report, write_documents
from turnstile.plans.roundtrip import ORACLE as TURNS
from turnstile.plans.synth_pages import chat_pages
from turnstile.session import ensure_checkpoint_dir

NL = "chr(10)"
DATE = "2024-01-01T00:00:00"
TITLE = "Chat export"


def _turns(spark: SparkSession, sf_dir: str, template: str, detector: str) -> DataFrame:
    turns = extract(chat_pages(spark, sf_dir, template), Options(detector=detector)).turns
    return turns.withColumn("content", py_strip(F.col("content")))


def _named(docs: DataFrame) -> DataFrame:
    return docs.withColumnRenamed("page_id", "conv_id")


def rt_markdown(spark, sf_dir):
    """Markdown of each page, planted code, diagrams and formulas included."""
    return _named(render_markdown(_turns(spark, sf_dir, "data_attr", "heuristic")))


def rt_frontmatter(spark, sf_dir):
    """The same with front matter, over pages without role marks."""
    return _named(render_markdown(_turns(spark, sf_dir, "separator", "heuristic"), True, TITLE, DATE))


def rt_json(spark, sf_dir):
    """Session JSON of each page."""
    return _named(render_json(_turns(spark, sf_dir, "data_attr", "heuristic")))


def rt_yaml(spark, sf_dir):
    """The same session without confidence, over pages found by clustering."""
    return _named(render_json(_turns(spark, sf_dir, "topology", "topo"), with_confidence=False)).withColumnRenamed("json", "yaml")


def rt_report(spark, sf_dir):
    """Report over extracted turns with its header facts."""
    return _named(render_report(_turns(spark, sf_dir, "data_attr", "heuristic"), DATE, "1", "md"))


def rt_sink(spark, sf_dir):
    """Documents written by the sink into the shared folder, read back."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"documents-{uuid.uuid4().hex}")
    write_documents(render_markdown(_turns(spark, sf_dir, "separator", "heuristic")), path)
    return _named(read_documents(spark, path))


def _auto(spark, sf_dir, template):
    return _turns(spark, sf_dir, template, "auto").select(
        F.col("page_id").alias("conv_id"), "idx", "role", "confidence", "strategy", "content")


def rt_auto_data_attr(spark, sf_dir):
    """Probes whose blocks have two roles are valid; a conversation of
    one role fails that test in both passes and gives its whole body."""
    return _auto(spark, sf_dir, "data_attr")


def rt_auto_class(spark, sf_dir):
    """O59 on role classes: as above, from the class probe."""
    return _auto(spark, sf_dir, "semantic")


def rt_auto_hr_body(spark, sf_dir):
    """Separated turns show no role, so neither pass is valid."""
    return _auto(spark, sf_dir, "separator")


def rt_auto_topo_body(spark, sf_dir):
    """As above where the clustering pass finds the blocks."""
    return _auto(spark, sf_dir, "topology")


def _markdown_sql(turns: str, head: str = "''") -> str:
    label = "CASE WHEN role = 'user' THEN 'User' ELSE 'MODEL' END"
    piece = f"'## ' || {label} || {NL} || {NL} || content || {NL} || {NL} || '---' || {NL} || {NL}"
    return f"""
        SELECT conv_id, count(*) AS n_turns,
               replace({head} || string_agg({piece}, '' ORDER BY idx), {NL} || {NL} || {NL}, {NL} || {NL}) AS markdown
        FROM ({turns}) GROUP BY conv_id"""


def _json_sql(turns: str, confidence: str, name: str) -> str:
    return f"""
        SELECT conv_id, CAST(to_json({{'session': {{'id': md5(CAST(conv_id AS VARCHAR)),
               'turns': list({{'index': idx, 'role': role, {confidence}
                              'content': [{{'type': 'text', 'content': content}}]}} ORDER BY idx)}}}})
               AS VARCHAR) AS {name}
        FROM ({turns}) GROUP BY conv_id"""


_ONE_ROLE = """(SELECT conv_id FROM conversations GROUP BY conv_id
                HAVING count(DISTINCT CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) < 2)"""


def _body_sql(where: str, between: str) -> str:
    """One turn of the whole body, noise removed."""
    return f"""
        SELECT conv_id, CAST(0 AS BIGINT) AS idx, 'user' AS role, CAST(0.4 AS DOUBLE) AS confidence,
               'fallback_body' AS strategy, string_agg(text, {between} ORDER BY turn) AS content
        FROM conversations {where} GROUP BY conv_id"""


ORACLE = {
    "rt_markdown": _markdown_sql(TURNS["rt_data_attr"]),
    "rt_frontmatter": _markdown_sql(
        TURNS["rt_hr"], f"'---' || {NL} || 'title: {TITLE}' || {NL} || 'date: {DATE}' || {NL} || 'turns_count: '"
                        f" || CAST(count(*) AS VARCHAR) || {NL} || '---' || {NL} || {NL}"),
    "rt_sink": f"SELECT conv_id, markdown FROM ({_markdown_sql(TURNS['rt_hr'])})",
    "rt_json": _json_sql(TURNS["rt_data_attr"], "'confidence': confidence,", "json"),
    "rt_yaml": _json_sql(TURNS["rt_topology"], "", "yaml"),
    "rt_report": f"""
        SELECT conv_id, '# Extraction report - ' || CAST(conv_id AS VARCHAR) || {NL} || {NL}
               || '- **Date**: {DATE}' || {NL} || '- **Status**: SUCCESS' || {NL} || '- **Version**: 1' || {NL}
               || '- **Format**: md' || {NL} || '- **Turns**: ' || CAST(count(*) AS VARCHAR) || {NL} || {NL}
               || '## Turns' || {NL} || {NL}
               || string_agg('### Turn ' || CAST(idx AS VARCHAR) || ' - ' || role || ' (confidence: '
                             || printf('%.2f', confidence) || ')' || {NL} || '> '
                             || replace(substring(content, 1, 120), {NL}, ' ') || '...' || {NL} || {NL},
                             '' ORDER BY idx) AS report
        FROM ({TURNS['rt_data_attr']}) GROUP BY conv_id""",
    "rt_auto_data_attr": f"""
        SELECT conv_id, idx, role, confidence, 'auto_heuristic' AS strategy, content
        FROM ({TURNS['rt_data_attr']}) WHERE conv_id NOT IN {_ONE_ROLE}
        UNION ALL {_body_sql(f'WHERE conv_id IN {_ONE_ROLE}', f'{NL} || {NL}')}""",
    "rt_auto_class": f"""
        SELECT conv_id, idx, role, confidence, 'auto_heuristic' AS strategy, content
        FROM ({TURNS['rt_semantic_class']}) WHERE conv_id NOT IN {_ONE_ROLE}
        UNION ALL {_body_sql(f'WHERE conv_id IN {_ONE_ROLE}', f'{NL} || {NL}')}""",
    "rt_auto_hr_body": _body_sql("", f"{NL} || '---' || {NL}"),
    "rt_auto_topo_body": _body_sql("", "''"),
}

QUERIES = {
    "rt_markdown": rt_markdown,
    "rt_frontmatter": rt_frontmatter,
    "rt_json": rt_json,
    "rt_yaml": rt_yaml,
    "rt_report": rt_report,
    "rt_sink": rt_sink,
    "rt_auto_data_attr": rt_auto_data_attr,
    "rt_auto_class": rt_auto_class,
    "rt_auto_hr_body": rt_auto_hr_body,
    "rt_auto_topo_body": rt_auto_topo_body,
}
