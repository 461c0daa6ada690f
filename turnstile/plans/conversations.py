"""Queries over the ``conversations`` table (O07, O17, O26, O58, O61-O66,
O81-O85). Every query reads the whole table; conversations are grouped by
``conv_id`` with ordered string aggregates (``listagg ... WITHIN GROUP``),
never collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnstile.functions.text import fmt2, preview, py_strip, py_words, squeeze_once
from turnstile.operators import roles as R
from turnstile.sources.tables import read_table

DEFAULT_TITLE = "Chat export"
DEFAULT_DATE = "2024-01-01T00:00:00"
TURN_CHUNK = 4096


def _conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def _label(role: F.Column) -> F.Column:
    # The Markdown header is "User" for user turns and "MODEL" otherwise
    return F.when(role == "user", F.lit("User")).otherwise(F.lit("MODEL"))


def _md_pieces(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "piece", F.concat(F.lit("## "), _label(F.col("role")), F.lit("\n\n"), F.col("text"),
                          F.lit("\n"), F.lit("\n---\n\n")))


def _ordered_concat(col: str, order: str) -> F.Column:
    return F.expr(f"listagg({col}, '') WITHIN GROUP (ORDER BY {order})")


def _concat_by_conv(df: DataFrame, col: str, out: str) -> DataFrame:
    """Ordered concatenation per conversation in two levels: bounded chunks
    of turns are concatenated first (map-side work spread over tasks), then
    the few chunk strings of a conversation are joined in order. Returns
    (conv_id, n_turns, out)."""
    c = df.withColumn("_chunk", F.floor(F.col("turn") / TURN_CHUNK))
    part = c.groupBy("conv_id", "_chunk").agg(F.count("*").alias("_n"), _ordered_concat(col, "turn").alias("_s"))
    return part.groupBy("conv_id").agg(F.sum("_n").alias("n_turns"), _ordered_concat("_s", "_chunk").alias(out))


def session_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O63 + O65 + O81 + O83: one Markdown document per conversation."""
    p = _md_pieces(_conv(spark, sf_dir))
    return (_concat_by_conv(p, "piece", "body")
            .select("conv_id", "n_turns", squeeze_once(F.col("body")).alias("markdown")))


def session_frontmatter(spark: SparkSession, sf_dir: str, title: str = DEFAULT_TITLE,
                        date: str = DEFAULT_DATE) -> DataFrame:
    """Front matter (title, date parameter, turn count) then the body."""
    p = _md_pieces(_conv(spark, sf_dir))
    g = _concat_by_conv(p, "piece", "body")
    doc = F.concat(F.lit(f"---\ntitle: {title}\ndate: {date}\nturns_count: "),
                   F.col("n_turns").cast("string"), F.lit("\n---\n\n"), F.col("body"))
    return g.select("conv_id", "n_turns", squeeze_once(doc).alias("markdown"))


def _model_role(role: F.Column) -> F.Column:
    return F.when(role == "assistant", F.lit("model")).otherwise(role)


def session_json_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O07 + O65: session JSON (id, turns[index, role, confidence, content[]]).
    The session id is deterministic: md5 of the conversation id."""
    c = _conv(spark, sf_dir)
    turn = F.struct(F.col("turn").alias("index"), _model_role(F.col("role")).alias("role"),
                    F.lit(1.0).alias("confidence"),
                    F.array(F.struct(F.lit("text").alias("type"),
                                     F.col("text").alias("content"))).alias("content"))
    g = c.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", turn.alias("t")))).alias("ts"))
    sess = F.struct(F.struct(F.md5(F.col("conv_id").cast("string")).alias("id"),
                             F.transform("ts", lambda x: x["t"]).alias("turns")).alias("session"))
    return g.select("conv_id", F.to_json(sess, {"ignoreNullFields": "false"}).alias("json"))


def session_yaml_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The YAML form carries the same session without confidence; JSON
    is valid YAML 1.2, so the document is written as JSON text."""
    c = _conv(spark, sf_dir)
    turn = F.struct(F.col("turn").alias("index"), _model_role(F.col("role")).alias("role"),
                    F.array(F.struct(F.lit("text").alias("type"),
                                     F.col("text").alias("content"))).alias("content"))
    g = c.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", turn.alias("t")))).alias("ts"))
    sess = F.struct(F.struct(F.md5(F.col("conv_id").cast("string")).alias("id"),
                             F.transform("ts", lambda x: x["t"]).alias("turns")).alias("session"))
    return g.select("conv_id", F.to_json(sess, {"ignoreNullFields": "false"}).alias("yaml"))


def turn_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O17 on turn text: words of the stripped text, and characters."""
    c = _conv(spark, sf_dir)
    return c.select("conv_id", "turn", py_words(F.col("text")).alias("n_words"),
                    F.length("text").alias("n_chars"))


def turn_min_words(spark: SparkSession, sf_dir: str, min_words: int = 3) -> DataFrame:
    """Keep turns with at least ``min_words`` words."""
    c = _conv(spark, sf_dir).withColumn("n_words", py_words(F.col("text")))
    return c.filter(F.col("n_words") >= min_words).select("conv_id", "turn", "role", "n_words")


def _inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O60 + O61 with the source role name as the class string."""
    c = _conv(spark, sf_dir)
    u, m = R.role_scores(F.col("role"))
    c = c.withColumn("strong", R.strong_role(u, m))
    # conversations may be hot keys: the role scan runs in bounded chunks
    return R.alternate(c, ["conv_id"], "turn", chunk=TURN_CHUNK)


def role_alternation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _inferred(spark, sf_dir)
    return d.select("conv_id", "turn", F.col("role").alias("inferred_role"), "confidence")


def turn_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report per conversation, one preview line per turn."""
    d = _inferred(spark, sf_dir)
    line = F.concat(F.lit("### Turn "), F.col("turn").cast("string"), F.lit(" - "), F.col("role"),
                    F.lit(" (confidence: "), fmt2(F.col("confidence")), F.lit(")\n> "),
                    preview(F.col("text")), F.lit("\n\n"))
    g = _concat_by_conv(d.withColumn("line", line), "line", "lines")
    head = F.concat(F.lit("# Extraction report - conversation "), F.col("conv_id").cast("string"),
                    F.lit("\n\n- **Turns**: "), F.col("n_turns").cast("string"),
                    F.lit("\n\n## Turns\n\n"), F.col("lines"))
    return g.select("conv_id", head.alias("report"))


def _legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _conv(spark, sf_dir)
    label, conf = R.legacy_vote(F.col("role"), F.length(py_strip(F.col("text"))), F.col("turn"))
    return c.withColumn("label", label).withColumn("confidence", conf)


def role_vote_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _legacy(spark, sf_dir)
    return d.select("conv_id", "turn", "label", "confidence")


def low_confidence(spark: SparkSession, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    """Low-confidence marker per turn, summarised per conversation."""
    d = _legacy(spark, sf_dir)
    low = F.col("confidence") < threshold
    marker = F.when(low, F.concat(F.lit("<!-- role confidence: "),
                                  F.bround(F.col("confidence") * 100, 0).cast("int").cast("string"),
                                  F.lit("% -->")))
    d = d.withColumn("low", low).withColumn("marker", marker)
    return d.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.sum(F.col("low").cast("int")).alias("n_low"),
        F.round(F.min("confidence"), 6).alias("min_conf"),
        F.round(F.avg("confidence"), 6).alias("avg_conf"),
        F.max("marker").alias("last_marker"))


def session_valid(spark: SparkSession, sf_dir: str, min_coverage: float = 0.15,
                  block_depth: int = 3) -> DataFrame:
    """O58 over conversations: each turn is a block, the body is all turns
    glued (word count = sum - (nonempty - 1))."""
    c = _conv(spark, sf_dir).withColumn("w", py_words(F.col("text")))
    u, m = R.role_scores(F.col("role"))
    c = c.withColumn("r0", R.context_free_role(u, m))
    g = c.groupBy("conv_id").agg(
        F.count("*").alias("n_blocks"), F.count_distinct("r0").alias("n_roles"),
        F.sum("w").alias("block_words"), F.sum((F.col("w") > 0).cast("int")).alias("ne"))
    total = F.col("block_words") - F.greatest(F.col("ne") - 1, F.lit(0))
    cov = F.try_divide(F.col("block_words").cast("double"), total.cast("double"))
    valid = ((total > 0)
             & ~((F.col("n_blocks") == 1) & F.lit(block_depth < 3) & (cov > 0.7))
             & ~((F.col("n_blocks") >= 2) & (F.col("n_roles") == 1))
             & (cov >= min_coverage))
    return g.select("conv_id", "n_blocks", "n_roles", F.round(cov, 6).alias("coverage"),
                    valid.alias("valid"))


NL = "chr(10)"
_PIECE_SQL = (f"'## ' || CASE WHEN role = 'user' THEN 'User' ELSE 'MODEL' END || {NL} || {NL} || text"
              f" || {NL} || {NL} || '---' || {NL} || {NL}")
_SQUEEZE = f"replace(%s, {NL} || {NL} || {NL}, {NL} || {NL})"
_ROLE_SIG_SQL = (
    "(CASE WHEN role = 'user' THEN 'user' WHEN role = 'assistant' THEN 'model' ELSE NULL END)")

ORACLE = {
    "session_markdown": f"""
        SELECT conv_id, count(*) AS n_turns,
               {_SQUEEZE % ("string_agg(" + _PIECE_SQL + ", '' ORDER BY turn)")} AS markdown
        FROM conversations GROUP BY conv_id""",
    "session_frontmatter": f"""
        SELECT conv_id, count(*) AS n_turns,
               {_SQUEEZE % ("'---' || " + NL + " || 'title: " + DEFAULT_TITLE + "' || " + NL
                            + " || 'date: " + DEFAULT_DATE + "' || " + NL + " || 'turns_count: ' || "
                            "CAST(count(*) AS VARCHAR) || " + NL + " || '---' || " + NL + " || " + NL
                            + " || string_agg(" + _PIECE_SQL + ", '' ORDER BY turn)")} AS markdown
        FROM conversations GROUP BY conv_id""",
    "session_json_turns": """
        SELECT conv_id, CAST(to_json({'session': {'id': md5(CAST(conv_id AS VARCHAR)),
               'turns': list({'index': turn,
                              'role': CASE WHEN role = 'assistant' THEN 'model' ELSE role END,
                              'confidence': 1.0::DOUBLE,
                              'content': [{'type': 'text', 'content': text}]} ORDER BY turn)}})
               AS VARCHAR) AS json
        FROM conversations GROUP BY conv_id""",
    "turn_density": """
        SELECT conv_id, turn,
               len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n_words,
               length(text) AS n_chars
        FROM conversations""",
    "turn_min_words": """
        SELECT conv_id, turn, role, n_words FROM (
          SELECT conv_id, turn, role,
                 len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n_words
          FROM conversations) WHERE n_words >= 3""",
    "role_alternation": f"""
        WITH s AS (
          SELECT conv_id, turn, {_ROLE_SIG_SQL} AS strong FROM conversations),
        w AS (
          SELECT *, last_value(strong IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s_role,
                    last_value(CASE WHEN strong IS NOT NULL THEN turn END IGNORE NULLS)
                      OVER (PARTITION BY conv_id ORDER BY turn
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s_idx
          FROM s)
        SELECT conv_id, turn,
               CASE WHEN strong IS NOT NULL THEN strong
                    WHEN s_role IS NULL THEN CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'model' END
                    WHEN (turn - s_idx) % 2 = 0 THEN s_role
                    WHEN s_role = 'user' THEN 'model' ELSE 'user' END AS inferred_role,
               CASE WHEN strong IS NOT NULL THEN 0.8 WHEN turn = 0 THEN 0.4 ELSE 0.5 END::DOUBLE
                 AS confidence
        FROM w""",
}

_LEGACY_SQL = f"""
    SELECT conv_id, turn, u2, m2,
           CASE WHEN u2 > m2 THEN 'User' ELSE 'Model' END AS label,
           CASE WHEN u2 > m2 THEN u2 / (u2 + m2)::DOUBLE ELSE m2 / (u2 + m2)::DOUBLE END AS confidence
    FROM (
      SELECT conv_id, turn,
             u + CASE WHEN u = m AND turn % 2 = 0 THEN 1 ELSE 0 END AS u2,
             m + CASE WHEN u = m AND turn % 2 <> 0 THEN 1 ELSE 0 END AS m2
      FROM (
        SELECT conv_id, turn,
          CASE WHEN regexp_matches(role, '(?i){R.LEGACY_USER}') THEN 3 ELSE 0 END
            + CASE WHEN length(text) < 150 THEN 1 ELSE 0 END AS u,
          CASE WHEN regexp_matches(role, '(?i){R.LEGACY_MODEL}') THEN 3 ELSE 0 END
            + CASE WHEN length(text) > 300 THEN 1 ELSE 0 END AS m
        FROM conversations))"""

ORACLE["role_vote_legacy"] = f"SELECT conv_id, turn, label, confidence FROM ({_LEGACY_SQL})"
ORACLE["low_confidence"] = f"""
    SELECT conv_id, count(*) AS n_turns, sum(CASE WHEN confidence < 0.7 THEN 1 ELSE 0 END) AS n_low,
           round(min(confidence), 6) AS min_conf, round(avg(confidence), 6) AS avg_conf,
           max(CASE WHEN confidence < 0.7 THEN '<!-- role confidence: '
                    || CAST(CAST(round_even(confidence * 100, 0) AS INTEGER) AS VARCHAR) || '% -->' END)
             AS last_marker
    FROM ({_LEGACY_SQL}) GROUP BY conv_id"""
ORACLE["turn_preview"] = f"""
    WITH r AS ({ORACLE['role_alternation']}),
    t AS (SELECT r.conv_id, r.turn, r.inferred_role AS role, r.confidence, c.text
          FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn)
    SELECT conv_id,
           '# Extraction report - conversation ' || CAST(conv_id AS VARCHAR) || {NL} || {NL}
           || '- **Turns**: ' || CAST(count(*) AS VARCHAR) || {NL} || {NL} || '## Turns' || {NL} || {NL}
           || string_agg('### Turn ' || CAST(turn AS VARCHAR) || ' - ' || role || ' (confidence: '
                         || printf('%.2f', confidence) || ')' || {NL} || '> '
                         || replace(substring(text, 1, 120), {NL}, ' ') || '...' || {NL} || {NL},
                         '' ORDER BY turn) AS report
    FROM t GROUP BY conv_id"""
ORACLE["session_valid"] = """
    SELECT conv_id, n_blocks, n_roles, round(cov, 6) AS coverage,
           (total > 0 AND NOT (n_blocks >= 2 AND n_roles = 1) AND cov >= 0.15) AS valid
    FROM (
      SELECT conv_id, count(*) AS n_blocks,
             count(DISTINCT CASE WHEN role = 'assistant' THEN 'model' ELSE 'user' END) AS n_roles,
             sum(w) - greatest(sum(CASE WHEN w > 0 THEN 1 ELSE 0 END) - 1, 0) AS total,
             sum(w) / (sum(w) - greatest(sum(CASE WHEN w > 0 THEN 1 ELSE 0 END) - 1, 0)) AS cov
      FROM (SELECT conv_id, role,
                   len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS w
            FROM conversations)
      GROUP BY conv_id)"""

ORACLE["session_yaml_turns"] = """
    SELECT conv_id, CAST(to_json({'session': {'id': md5(CAST(conv_id AS VARCHAR)),
           'turns': list({'index': turn,
                          'role': CASE WHEN role = 'assistant' THEN 'model' ELSE role END,
                          'content': [{'type': 'text', 'content': text}]} ORDER BY turn)}})
           AS VARCHAR) AS yaml
    FROM conversations GROUP BY conv_id"""

QUERIES = {
    "session_markdown": session_markdown,
    "session_yaml_turns": session_yaml_turns,
    "session_frontmatter": session_frontmatter,
    "session_json_turns": session_json_turns,
    "turn_density": turn_density,
    "turn_min_words": turn_min_words,
    "turn_preview": turn_preview,
    "role_alternation": role_alternation,
    "role_vote_legacy": role_vote_legacy,
    "low_confidence": low_confidence,
    "session_valid": session_valid,
}
