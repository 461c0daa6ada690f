"""Rules on nodes and blocks where each fires, against SQL: interface and
empty elements and attribute names (O20, O21, O89), unfenced diagrams (O38),
protected blocks in one another and repeated (O32, O33), raw mode (O35), the
repetition probe (O42), regrouped fragments (O97), signature clusters (O55-O57)
and the older pipeline (O22-O24, O52, O62, O80).

Pages are built from ``conversations`` by a Spark job; texts stay whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnstile.functions.text import py_strip
from turnstile.operators.extract import Options, extract, prepare, regroup
from turnstile.operators.legacy import legacy_extract
from turnstile.operators.predicates import is_empty_node, is_ui_element, scrub_attrs, wrap_mermaid
from turnstile.operators.probes import heuristic_blocks
from turnstile.operators.roles import LEGACY_MODEL, LEGACY_USER
from turnstile.operators.topology import signature_blocks
from turnstile.plans.conversations import ORACLE as CONVERSATIONS
from turnstile.plans.planted import _WORDS_SQL
from turnstile.plans.synth_pages import esc
from turnstile.sources.tables import read_table

NL = "chr(10)"


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def _pages(spark: SparkSession, sf_dir: str, turn_html: Column, **others: Column) -> DataFrame:
    """One page for each conversation, ``turn_html`` of its turns within
    ``main``, then what ``others`` give, within elements of these names."""
    parts = {"main": turn_html, **others}
    t = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    g = (t.select("conv_id", "turn", *[h.alias(n) for n, h in parts.items()]).groupBy("conv_id")
         .agg(*[F.expr(f"listagg({n}, '') WITHIN GROUP (ORDER BY turn)").alias(n) for n in parts]))
    html = F.concat(F.lit("<html><body>"), *[x for n in parts for x in (F.lit(f"<{n}>"), F.col(n), F.lit(f"</{n}>"))],
                    F.lit("</body></html>"))
    return g.select(F.col("conv_id").alias("page_id"), F.lit("").alias("url"), html.alias("html"))


def _marked(m: DataFrame) -> DataFrame:
    """The elements that carry their turn's number (``data-t``), with it."""
    t = F.col("attrs")["data-t"].cast("long")
    return m.filter((F.col("kind") == "tag") & t.isNotNull()).withColumn("turn", t)


# ---- O20, O21, O89 ----

UI_CLASSES = ("msg", "msg copy-Code", "NavBar wide", "plain")
#: No interface words, but near ones; names of attributes that go and that look like them.
ATTRIBUTES = (' _n="1" ng-if="x"', ' ngx="1" n_="2"', ' ng-="" data-_a="3"')


def node_rules_planted(spark, sf_dir):
    """Each turn is an element whose tag, classes, attributes
    and content vary with its number."""
    turn = F.col("turn")
    name = F.when(turn % 5 == 4, F.lit("footer")).otherwise(F.lit("div"))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (turn % len(values) + 1).cast("int"))
    body = F.when((F.col("conv_id") + turn) % 3 == 0, F.lit("<span> \n </span><br>")).otherwise(esc(F.col("text")))
    m, *_ = prepare(_pages(spark, sf_dir, F.concat(
        F.lit("<"), name, F.lit(' data-t="'), _text("turn"), F.lit('" class="'), pick(UI_CLASSES), F.lit('"'), pick(ATTRIBUTES), F.lit(">"),
        body, F.lit("</"), name, F.lit(">"))), Options(raw=True))
    return _marked(m).select(
        F.col("page_id").alias("conv_id"), "turn", is_ui_element(F.col("classes"), F.col("name")).alias("ui"),
        is_empty_node(F.col("ne_f")).alias("empty"),
        F.array_join(F.array_sort(F.map_keys(scrub_attrs(F.col("attrs")))), ",").alias("kept"))


# ---- O38 ----

#: What stands before and behind a text, and what becomes of it: a diagram up to
#: a blank line, one line only, one with a fence, one up to a heading, one up to
#: the end with a line end behind it, and a longer word.
DIAGRAMS = (
    ("", "\n\ngraph TD\nA-->B\n\nend", "", "\n\n\n```mermaid\ngraph TD\nA-->B\n```\n\n\nend"),
    ("", "\nPIE chart", "", "\nPIE chart"),
    ("", "\nflowchart LR\n```\nx", "", "\nflowchart LR\n```\nx"),
    ("sequenceDiagram\nA->>B: hi\n# Title\n", "", "\n\n```mermaid\nsequenceDiagram\nA->>B: hi\n```\n\n# Title\n", ""),
    ("", "\nmindmap\n root\n", "", "\n\n```mermaid\nmindmap\n root\n```\n\n"),
    ("", "\ngraphical\nwords", "", "\ngraphical\nwords"),
)


def mermaid_planted(spark, sf_dir):
    """Diagrams put before and behind every text are fenced or not."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k = (F.col("doc_id") % len(DIAGRAMS) + 1).cast("int")
    side = lambda n: F.element_at(F.array(*[F.lit(x[n]) for x in DIAGRAMS]), k)
    t = wrap_mermaid(F.concat(side(0), F.col("text"), side(1)))
    return d.select("doc_id", F.length(t).alias("n_chars"), F.md5(t).alias("md5"))


def _text_sql(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", f"' || {NL} || '") + "'"


def _pick_sql(key: str, values) -> str:
    cases = " ".join(f"WHEN {k} THEN {_text_sql(v)}" for k, v in enumerate(values))
    return f"(CASE {key} % {len(values)} {cases} END)"


# ---- O32, O33 ----

def protect_claims(spark, sf_dir):
    """Formulas within code and within diagrams go with these, and
    blocks of equal content share an entry: first position, last formatting.
    ``turn`` is that of the first position."""
    turn = F.col("turn")
    tex = lambda body: F.concat(F.lit('<annotation encoding="application/x-tex">'), body, F.lit("</annotation>"))
    mark = F.concat(F.lit(' data-t="'), _text("turn"), F.lit('"'))
    block = (F.when(turn % 3 == 0, F.concat(F.lit("<pre"), mark, F.lit('><code class="language-c">f('), _text("conv_id"), F.lit(") "),
                                            F.lit('<span class="katex">'), tex(F.lit("a")), F.lit("</span></code></pre>")))
             .when(turn % 3 == 1, F.concat(F.lit("<div"), mark, F.lit(">graph TD\n A["), _text("turn"), F.lit("] --> <math>"), tex(F.lit("b")),
                                           F.lit("</math></div>")))
             .otherwise(F.concat(F.lit("<p>so <math"), mark, F.when(turn > 4, F.lit(' display="block"')).otherwise(F.lit("")), F.lit(">"),
                                 tex(F.concat(F.lit("y^"), _text("conv_id"))), F.lit("</math></p>"))))
    m, protected, *_ = prepare(_pages(spark, sf_dir, F.concat(F.lit("<section><span>"), esc(F.col("text")), F.lit("</span>"), block,
                                                              F.lit("</section>"))), Options())
    first = _marked(m).select("page_id", F.col("node_id").alias("pos"), "turn")
    return (protected.join(first, ["page_id", "pos"], "left")
            .select(F.col("page_id").alias("conv_id"), "turn", "key", "ptype", "raw", "formatted"))


# ---- O35 ----

def rt_raw(spark, sf_dir):
    """Without protection a diagram and the strings of a formula are plain
    text, and its placeholder is in no turn."""
    turn = F.col("turn")
    html = F.concat(F.lit('<div data-testid="conversation-turn-'), _text("turn"), F.lit('" class="'), F.col("role"), F.lit('-turn"><div><p>'),
                    esc(F.col("text")), F.lit("</p>"),
                    F.when(turn % 2 == 0, F.concat(F.lit("<div>graph TD; A["), _text("turn"), F.lit("]</div>")))
                    .otherwise(F.lit('<span class="katex"><math><mi>x</mi><annotation encoding="application/x-tex">x^2</annotation>'
                                     "</math></span>")), F.lit("</div></div>"))
    ex = extract(_pages(spark, sf_dir, html), Options(detector="heuristic", raw=True))
    return ex.turns.select(F.col("page_id").alias("conv_id"), "idx", "role", "confidence", py_strip(F.col("content")).alias("content"))


# ---- O42 ----

def rt_repetition(spark, sf_dir):
    """Elements of the most frequent parent and child pair with more than
    five words, on pages that have four of them; every fourth turn is cut."""
    text = F.when(F.col("turn") % 4 == 1, F.lit("only five words are here")).otherwise(esc(F.col("text")))
    m, *_ = prepare(_pages(spark, sf_dir, F.concat(
        F.lit('<section><div data-t="'), _text("turn"), F.lit('">'), text, F.lit("</div><div>a short line</div></section>"))), Options(raw=True))
    return (heuristic_blocks(m).join(_marked(m).select("page_id", "node_id", "turn"), ["page_id", "node_id"])
            .select(F.col("page_id").alias("conv_id"), "turn", "probe", F.col("conf").alias("confidence")))


# ---- O97 ----

PARTS = tuple(f"part {n} of this turn is here." for n in ("one", "two", "three", "four"))


def rt_fragments(spark, sf_dir):
    """Each turn is a section of fragments, which the repetition probe
    finds one by one; regrouped, a section is one turn with its own role."""
    pages = _pages(spark, sf_dir, F.concat(
        F.lit('<section class="turn '), F.col("role"), F.lit('"><div>'), esc(F.col("text")), F.lit("</div>"),
        F.lit("".join(f"<div>{p}</div>" for p in PARTS)), F.lit("</section>")))
    r = regroup(extract(pages, Options(detector="heuristic")))
    return r.select(F.col("page_id").alias("conv_id"), "idx", "role", "confidence", py_strip(F.col("content")).alias("content"))


# ---- O55, O56, O57 ----

def signature_planted(spark, sf_dir):
    """Every turn is an element of five words in ``main``, with a line
    break if its number is odd (signatures that agree but for one child) and of
    one word if it is 3 modulo 4 (let in again if its signature wins), and one
    of nine words in ``aside`` (``turn`` + 1000) at irregular places."""
    turn, t = F.col("turn"), _text("turn")
    even = F.concat(F.lit('<div class="even" data-t="'), t, F.lit('">'),
                    F.when(turn % 4 == 3, F.lit("tiny")).otherwise(F.concat(F.lit("word number "), t, F.lit(" of five"))),
                    F.when(turn % 2 == 1, F.lit("<br>")).otherwise(F.lit("")), F.lit("</div>"))
    odd = F.concat(F.repeat(F.lit("<hr>"), (turn * turn % 5).cast("int")), F.lit('<p class="odd" data-t="'),
                   (turn + 1000).cast("string"), F.lit('">one two three four five six seven eight nine</p>'))
    text = F.concat(F.lit('<section class="k'), t, F.lit('x">'), esc(F.col("text")), F.lit("</section>"))
    m, *_ = prepare(_pages(spark, sf_dir, even, aside=odd, address=text), Options(raw=True))
    return (signature_blocks(m).join(_marked(m).select("page_id", "node_id", "turn"), ["page_id", "node_id"])
            .select(F.col("page_id").alias("conv_id"), "turn"))


# ---- O22-O24, O52, O62, O80 ----

LONG = "These twelve words make every turn dense enough to be a block."


def rt_older(spark, sf_dir):
    """Each turn is a bubble with a short child that
    names its speaker, an interface tag, a button, a line that is only a label,
    a heading, emphasis, a link, a list, a quote and a table; every third
    turn has no speaker, so that length or place decides."""
    name = F.when(F.col("turn") % 3 == 2, F.lit("note")).when(F.col("role") == "user", F.lit("human")).otherwise(F.lit("gpt"))
    bubble = F.concat(
        F.lit('<div class="bubble"><header>gone</header><b class="copy-btn">Copy</b><p>Thinking.</p><i>'), name, F.lit("</i><p> "),
        esc(F.col("text")), F.lit(f"</p><p>{LONG}</p><h3> Title "), _text("turn"),
        F.lit('</h3><p>see <strong>bold</strong> <a href="/u"> link </a><a>bare</a></p><ul><li> first</li><li>next</li></ul>'
              "<blockquote>said</blockquote><table><tr><th>k</th><th>v</th></tr><tr><td>"), _text("conv_id"),
        F.lit("</td><td> x </td></tr></table></div>"))
    first = F.when(F.col("turn") == 0, F.lit(f'<div class="bubble"><p>{LONG}</p></div>')).otherwise(F.lit(""))
    r = legacy_extract(_pages(spark, sf_dir, F.concat(first, bubble)))
    return r.select(F.col("page_id").alias("conv_id"), "idx", "label", F.round("confidence", 6).alias("confidence"), "content")


_LONG = f"'{LONG}'"
#: Strings of a bubble beside its name, text and numbers.
_OTHERS = len(LONG) + sum(map(len, ("Title", "see", "bold", "link", "bare", "first", "next", "said", "k", "v", "x"))) + 1
_KEPT = ("class,data-t", "class,data-t,n_,ngx", "class,data-_a,data-t")

ORACLE = {
    "node_rules_planted": f"""
        SELECT conv_id, turn, turn % 4 IN (1, 2) OR turn % 5 = 4 AS ui, (conv_id + turn) % 3 = 0 AS empty,
               {_pick_sql('turn', _KEPT)} AS kept
        FROM conversations""",
    "mermaid_planted": f"""
        SELECT doc_id, length(t) AS n_chars, md5(t) AS md5 FROM (
          SELECT doc_id, {_pick_sql('doc_id', [x[2] for x in DIAGRAMS])} || coalesce(text, '')
                         || {_pick_sql('doc_id', [x[3] for x in DIAGRAMS])} AS t FROM documents)""",
    "protect_claims": f"""
        WITH p AS (
          SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'mermaid' ELSE 'math' END AS ptype,
                 CASE turn % 3 WHEN 0 THEN 'f(' || conv_id || ') a' WHEN 1 THEN 'graph TD' || {NL} || ' A[' || turn || '] --> b'
                      ELSE 'y^' || conv_id END AS raw FROM conversations),
        f AS (
          SELECT *, CASE WHEN ptype = 'code' THEN '``` c' || {NL} || raw || {NL} || '```'
                         WHEN ptype = 'mermaid' THEN '```mermaid' || {NL} || raw || {NL} || '```'
                         WHEN turn > 4 THEN '$$' || {NL} || raw || {NL} || '$$' ELSE '$' || raw || '$' END AS formatted
          FROM p)
        SELECT conv_id, min(turn) AS turn, ptype, raw, arg_max(formatted, turn) AS formatted,
               '__TSK_' || CASE ptype WHEN 'code' THEN 'CODE' WHEN 'mermaid' THEN 'MERM' ELSE 'MATH' END
               || '_' || substr(md5(raw), 1, 16) || '__' AS key
        FROM f GROUP BY conv_id, ptype, raw""",
    "rt_raw": f"""
        WITH r AS ({CONVERSATIONS['role_alternation']})
        SELECT c.conv_id, c.turn AS idx, r.inferred_role AS role, r.confidence, c.text || {NL} || CASE WHEN c.turn % 2 = 0 THEN 'graph TD; A[' || c.turn || ']' ELSE 'xx^2' END AS content
        FROM conversations c JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn""",
    "rt_repetition": f"""
        SELECT conv_id, turn, 'repetition' AS probe, 0.4::DOUBLE AS confidence FROM (
          SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n
          FROM conversations WHERE turn % 4 <> 1 AND {_WORDS_SQL} > 5) WHERE n >= 4""",
    "rt_fragments": f"""
        WITH r AS ({CONVERSATIONS['role_alternation']})
        SELECT c.conv_id, c.turn AS idx, r.inferred_role AS role, r.confidence,
               CASE WHEN {_WORDS_SQL.replace('text', 'c.text')} > 5 THEN c.text ELSE '' END || {_text_sql(''.join(PARTS))} AS content
        FROM conversations c JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn""",
    "signature_planted": """
        WITH sized AS (SELECT conv_id, turn, turn % 2 AS sig, turn % 4 <> 3 AS dense FROM conversations),
        clusters AS (SELECT conv_id, sig FROM sized WHERE dense GROUP BY conv_id, sig HAVING count(*) >= 2),
        m AS (
          SELECT conv_id, 0 AS part, 5 AS words, turn + 1 AS place FROM sized JOIN clusters USING (conv_id, sig) WHERE dense
          UNION ALL
          SELECT conv_id, 1, 9, place FROM (
            SELECT conv_id, sum(1 + turn * turn % 5) OVER (PARTITION BY conv_id ORDER BY turn) AS place,
                   count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE n >= 2),
        g AS (SELECT *, place - lag(place) OVER (PARTITION BY conv_id, part ORDER BY place) AS gap FROM m),
        s AS (
          SELECT conv_id, part, count(*) * avg(words) * CASE WHEN count(*) < 3 THEN 1.0::DOUBLE
                 ELSE 1.0::DOUBLE / (1.0::DOUBLE + var_pop(gap)) END AS score FROM g GROUP BY conv_id, part),
        best AS (SELECT conv_id, part FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, part) = 1)
        SELECT conv_id, turn FROM sized JOIN clusters USING (conv_id, sig) JOIN best USING (conv_id) WHERE part = 0
        UNION ALL
        SELECT conv_id, turn + 1000 AS turn FROM conversations JOIN best USING (conv_id) WHERE part = 1""",
    "rt_older": f"""
        WITH c AS (
          SELECT conv_id, turn, turn + 1 AS idx, text,
                 CASE WHEN turn % 3 = 2 THEN 'note' WHEN role = 'user' THEN 'human' ELSE 'gpt' END AS name,
                 regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS own FROM conversations),
        n AS (
          SELECT *, length(name) + length(own) + length(turn::VARCHAR) + length(conv_id::VARCHAR) + {_OTHERS} AS chars,
                 (name = 'human')::INT + (length(own) < 30 AND regexp_matches(own, '(?i){LEGACY_USER}'))::INT AS cu,
                 (name = 'gpt')::INT + (length(own) < 30 AND regexp_matches(own, '(?i){LEGACY_MODEL}'))::INT AS cm FROM c),
        v AS (SELECT *, 2 * cu + (chars < 150)::INT AS u0, 2 * cm + (chars > 300)::INT AS m0 FROM n),
        w AS (SELECT *, u0 + (u0 = m0 AND idx % 2 = 0)::INT AS u, m0 + (u0 = m0 AND idx % 2 = 1)::INT AS m FROM v)
        SELECT conv_id, idx, CASE WHEN u > m THEN 'User' ELSE 'Model' END AS label,
               round(greatest(u, m)::DOUBLE / (u + m), 6) AS confidence,
               '*' || name || '*' || {NL} || own || {NL} || {NL} || {_LONG} || {NL} || {NL} || '### Title ' || turn || {NL} || {NL}
               || 'see **bold** [link](/u)bare' || {NL} || {NL} || '- first' || {NL} || '- next' || {NL} || {NL} || '> said' || {NL} || {NL}
               || '| k | v |' || {NL} || '| --- | --- |' || {NL} || '| ' || conv_id || ' | x |' AS content FROM w
        UNION ALL
        SELECT conv_id, 0 AS idx, 'User' AS label, 1.0::DOUBLE AS confidence, {_LONG} AS content FROM conversations WHERE turn = 0""",
}

QUERIES = {
    "node_rules_planted": node_rules_planted,
    "mermaid_planted": mermaid_planted,
    "protect_claims": protect_claims,
    "rt_raw": rt_raw,
    "rt_repetition": rt_repetition,
    "rt_fragments": rt_fragments,
    "signature_planted": signature_planted,
    "rt_older": rt_older,
}
