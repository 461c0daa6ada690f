"""Text operators over ``documents`` and ``conversations`` (O25, O37, O83,
O93). Results are compared as md5 digests of the rewritten text plus its
length, so whole texts are processed but the check stays compact."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from turnstile.functions.text import UI_LABEL_LINES, latex_dollars, squeeze_once, squeeze_runs, strip_ui_labels
from turnstile.sources.tables import read_table


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def _digest(c):
    return [F.length(c).alias("n_chars"), F.md5(c).alias("md5")]


def ui_label_strip(spark, sf_dir):
    """UI label lines removed (line-anchored, any case)."""
    return _docs(spark, sf_dir).select("doc_id", *_digest(strip_ui_labels(F.col("text"))))


def latex_normalise(spark, sf_dir):
    """Alternative LaTeX delimiters turned into dollar forms."""
    return _docs(spark, sf_dir).select("doc_id", *_digest(latex_dollars(F.col("text"))))


def blank_squeeze(spark, sf_dir):
    """Package form (one pass, 3 newlines -> 2) and legacy form (runs of
    3+ -> 2, then strip)."""
    d = _docs(spark, sf_dir)
    return d.select("doc_id", F.md5(squeeze_once(F.col("text"))).alias("md5_once"),
                    F.md5(squeeze_runs(F.col("text"))).alias("md5_runs"))


def alternation_anomaly(spark, sf_dir):
    """A turn whose role equals the previous turn's role is flagged."""
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    w = Window.partitionBy("conv_id").orderBy("turn")
    prev = F.lag("role").over(w)
    return c.select("conv_id", "turn", F.coalesce(prev == F.col("role"), F.lit(False)).alias("anomaly"))


ORACLE = {
    "ui_label_strip": f"""
        SELECT doc_id, length(t) AS n_chars, md5(t) AS md5 FROM (
          SELECT doc_id, regexp_replace(text, '(?im){UI_LABEL_LINES}', '', 'g') AS t FROM documents)""",
    "latex_normalise": r"""
        SELECT doc_id, length(t) AS n_chars, md5(t) AS md5 FROM (
          SELECT doc_id,
            regexp_replace(regexp_replace(
              regexp_replace(
                regexp_replace(text, '\\\\\((.*?)\\\\\)', '$\1$', 'g'),
                '(?s)\\\[(.*?)\\\]', chr(10) || chr(10) || '$$\1$$' || chr(10) || chr(10), 'g'),
              '\\\(', '$', 'g'), '\\\)', '$', 'g') AS t
          FROM documents)""",
    "blank_squeeze": r"""
        SELECT doc_id,
               md5(replace(text, chr(10) || chr(10) || chr(10), chr(10) || chr(10))) AS md5_once,
               md5(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'),
                                  '^\s+|\s+$', '', 'g')) AS md5_runs
        FROM documents""",
    "alternation_anomaly": """
        SELECT conv_id, turn,
               coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role, false) AS anomaly
        FROM conversations""",
}

QUERIES = {
    "ui_label_strip": ui_label_strip,
    "latex_normalise": latex_normalise,
    "blank_squeeze": blank_squeeze,
    "alternation_anomaly": alternation_anomaly,
}


def role_signal(spark, sf_dir):
    """Role words in attribute values (the role name) or the first 200
    characters of the turn text."""
    from turnstile.operators.predicates import has_role_signal
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn",
                    has_role_signal(F.create_map(F.lit("class"), F.col("role")), F.col("text")).alias("signal"))


def mermaid_wrap(spark, sf_dir):
    """O38 (set form over paragraphs) on whole documents."""
    from turnstile.operators.predicates import wrap_mermaid
    return _docs(spark, sf_dir).select("doc_id", *_digest(wrap_mermaid(F.col("text"))))


from turnstile.operators.predicates import ROLE_SIGNAL  # noqa: E402

ORACLE["role_signal"] = f"""
    SELECT conv_id, turn,
           regexp_matches(role || ' ' || substr(text, 1, 200), '{ROLE_SIGNAL}') AS signal
    FROM conversations"""
QUERIES["role_signal"] = role_signal
QUERIES["mermaid_wrap"] = mermaid_wrap
