"""Rules on inputs in which they fire.

The given tables hold no UI labels, LaTeX delimiters, blank runs, short or
repeated-role turns and no chat hosts. Each query here plants them into every
row by an expression over the row's own id, applies the operator, and is
compared with SQL that plants the same."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

from turnstile.functions.text import UI_LABEL_LINES, latex_dollars, py_words, squeeze_once, squeeze_runs, strip_ui_labels
from turnstile.operators import roles as R
from turnstile.operators.predicates import SOURCE_RULES, source_of
from turnstile.sources.tables import read_table

NL = "chr(10)"
#: A conversation is split into chunks of so many turns for the role scan; small, so that roles cross chunks.
SCAN_CHUNK = 4


def _documents(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def _turns(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def _by_id(key: Column, *choices: str) -> Column:
    """The choice at ``key`` modulo their number."""
    out = F.lit(choices[-1])
    for k, c in enumerate(choices[:-1]):
        out = F.when(key % len(choices) == k, F.lit(c)).otherwise(out)
    return out


def _by_id_sql(key: str, *choices: str) -> str:
    text = ["'" + c.replace("'", "''").replace("\n", f"' || {NL} || '") + "'" for c in choices]
    cases = " ".join(f"WHEN {key} % {len(text)} = {k} THEN {c}" for k, c in enumerate(text[:-1]))
    return f"(CASE {cases} ELSE {text[-1]} END)"


# What is planted; "user said", "models" and "end" are no labels.
LABELS_FIRST = ("User:\n", "thinking...\n", "Réflexion durant 12 secondes.\n", "user said\n")
LABELS_LAST = ("\nChatGPT a dit :", "\nassistant", "\nmodels\nAI:\nend")
FORMULAS = ("\\(a_1\\) and \\(b\\) ", "\\[c\n= d\\]", "\\\\(e\\\\) f", "")


def ui_label_planted(spark, sf_dir):
    """Label lines before and after each text go, look-alikes stay."""
    d = _documents(spark, sf_dir)
    t = strip_ui_labels(F.concat(_by_id(F.col("doc_id"), *LABELS_FIRST), F.coalesce("text", F.lit("")),
                                 _by_id(F.col("doc_id"), *LABELS_LAST)))
    return d.select("doc_id", F.length(t).alias("n_chars"), F.md5(t).alias("md5"))


def latex_planted(spark, sf_dir):
    """The delimiters before and after each text become dollar forms."""
    d = _documents(spark, sf_dir)
    plant = _by_id(F.col("doc_id"), *FORMULAS)
    t = latex_dollars(F.concat(plant, F.coalesce("text", F.lit("")), F.lit("\n"), plant))
    return d.select("doc_id", F.length(t).alias("n_chars"), F.md5(t).alias("md5"))


def squeeze_planted(spark, sf_dir):
    """O83 with 0 to 6 line ends between two copies of a text and after them."""
    d = _documents(spark, sf_dir)
    t = F.concat("text", F.repeat(F.lit("\n"), (F.col("doc_id") % 7).cast("int")), "text",
                 F.repeat(F.lit("\n"), (F.col("doc_id") % 5).cast("int")))
    return d.select("doc_id", F.md5(squeeze_once(t)).alias("md5_once"), F.md5(squeeze_runs(t)).alias("md5_runs"))


def min_words_planted(spark, sf_dir, min_words: int = 3):
    """Every fourth turn is cut to its first two words, and goes."""
    short = F.regexp_extract("text", r"^[ \n\t]*[^ \n\t]+([ \n\t]+[^ \n\t]+)?", 0)
    c = _turns(spark, sf_dir).withColumn("text", F.when(F.col("turn") % 4 == 1, short).otherwise(F.col("text")))
    n = py_words(F.col("text"))
    return c.select("conv_id", "turn", "role", n.alias("n_words")).where(F.col("n_words") >= min_words)


def anomaly_planted(spark, sf_dir):
    """Every third turn says ``user``, so that roles repeat."""
    c = _turns(spark, sf_dir).withColumn("role", F.when(F.col("turn") % 3 == 2, F.lit("user")).otherwise(F.col("role")))
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select("conv_id", "turn", F.coalesce(before == F.col("role"), F.lit(False)).alias("anomaly"))


def role_alternation_masked(spark, sf_dir):
    """Only every third turn shows its role; the others alternate
    from the last one, over chunk borders too."""
    u, m = R.role_scores(F.when(F.col("turn") % 3 == 1, F.col("role")).otherwise(F.lit("")))
    c = _turns(spark, sf_dir).withColumn("strong", R.strong_role(u, m))
    return R.alternate(c, ["conv_id"], "turn", chunk=SCAN_CHUNK).select(
        "conv_id", "turn", F.col("role").alias("inferred_role"), "confidence")


_HOSTS = tuple(h for h, _ in SOURCE_RULES) + ("example.org", "www.claude.ai")


def page_source_planted(spark, sf_dir):
    """Each page gets one of the known hosts or one of two others."""
    p = read_table(spark, sf_dir, "pages")
    url = F.concat(F.lit("HTTPS://"), F.upper(_by_id(F.col("page_id"), *_HOSTS)), F.lit(":443/c/"),
                   F.col("page_id").cast("string"))
    return source_of(spark, p.select("page_id", url.alias("url")))


_WORDS_SQL = r"len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))"
_RULES_SQL = ", ".join(f"('{h}', '{s}')" for h, s in SOURCE_RULES)

ORACLE = {
    "ui_label_planted": f"""
        SELECT doc_id, length(t) AS n_chars, md5(t) AS md5 FROM (
          SELECT doc_id, regexp_replace({_by_id_sql('doc_id', *LABELS_FIRST)} || coalesce(text, '')
                   || {_by_id_sql('doc_id', *LABELS_LAST)}, '(?im){UI_LABEL_LINES}', '', 'g') AS t
          FROM documents)""",
    "latex_planted": rf"""
        SELECT doc_id, length(t) AS n_chars, md5(t) AS md5 FROM (
          SELECT doc_id, replace(replace(
              regexp_replace(
                regexp_replace({_by_id_sql('doc_id', *FORMULAS)} || coalesce(text, '') || {NL}
                               || {_by_id_sql('doc_id', *FORMULAS)}, '\\\\\((.*?)\\\\\)', '$\1$', 'g'),
                '(?s)\\\[(.*?)\\\]', {NL} || {NL} || '$$\1$$' || {NL} || {NL}, 'g'),
              '\(', '$'), '\)', '$') AS t
          FROM documents)""",
    "squeeze_planted": rf"""
        SELECT doc_id, md5(replace(t, {NL} || {NL} || {NL}, {NL} || {NL})) AS md5_once,
               md5(regexp_replace(regexp_replace(t, '\n{{3,}}', {NL} || {NL}, 'g'), '^\s+|\s+$', '', 'g')) AS md5_runs
        FROM (SELECT doc_id, text || repeat({NL}, CAST(doc_id % 7 AS INTEGER)) || text
                     || repeat({NL}, CAST(doc_id % 5 AS INTEGER)) AS t FROM documents)""",
    "min_words_planted": rf"""
        SELECT conv_id, turn, role, n_words FROM (
          SELECT conv_id, turn, role, {_WORDS_SQL} AS n_words FROM (
            SELECT conv_id, turn, role, CASE WHEN turn % 4 = 1
                   THEN regexp_extract(text, '^[ \n\t]*[^ \n\t]+([ \n\t]+[^ \n\t]+)?', 0) ELSE text END AS text
            FROM conversations)) WHERE n_words >= 3""",
    "anomaly_planted": """
        SELECT conv_id, turn,
               coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role, false) AS anomaly
        FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'user' ELSE role END AS role FROM conversations)""",
    "role_alternation_masked": """
        WITH RECURSIVE s AS (
          SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k,
                 CASE WHEN turn % 3 = 1 AND role = 'user' THEN 'user'
                      WHEN turn % 3 = 1 AND role = 'assistant' THEN 'model' END AS strong
          FROM conversations),
        r AS (
          SELECT conv_id, turn, k, coalesce(strong, 'user') AS inferred_role,
                 CASE WHEN strong IS NULL THEN 0.4 ELSE 0.8 END AS confidence
          FROM s WHERE k = 1
          UNION ALL
          SELECT s.conv_id, s.turn, s.k,
                 coalesce(s.strong, CASE WHEN r.inferred_role = 'user' THEN 'model' ELSE 'user' END),
                 CASE WHEN s.strong IS NULL THEN 0.5 ELSE 0.8 END
          FROM s JOIN r ON s.conv_id = r.conv_id AND s.k = r.k + 1)
        SELECT conv_id, turn, inferred_role, CAST(confidence AS DOUBLE) AS confidence FROM r""",
    "page_source_planted": f"""
        SELECT p.page_id, p.host, coalesce(r.source, 'generic') AS source
        FROM (SELECT page_id, {_by_id_sql('page_id', *_HOSTS)} AS host FROM pages) p
        LEFT JOIN (VALUES {_RULES_SQL}) r(host, source) ON p.host = r.host""",
}

QUERIES = {
    "ui_label_planted": ui_label_planted,
    "latex_planted": latex_planted,
    "squeeze_planted": squeeze_planted,
    "min_words_planted": min_words_planted,
    "anomaly_planted": anomaly_planted,
    "role_alternation_masked": role_alternation_masked,
    "page_source_planted": page_source_planted,
}
