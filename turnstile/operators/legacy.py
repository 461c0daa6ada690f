"""The older monolith's pipeline, set-wise.

* O22: UI tags are removed with their subtrees;
* O23/O24: an element whose class matches the UI pattern and whose stripped
  text is under 40 characters, or whose whole stripped text (< 80 chars) is
  a UI label, is removed. The monolith does this node by node in document
  order on a shrinking tree; because an element is always visited before
  its descendants, its text is still that of the tree after O22, so the set
  form below gives the same result;
* O52: the parent with the best score over its dense children (> 10 glued
  words) wins; its dense children are the blocks; with no winner, every tag
  with a role signal is a block;
* O62: role vote per block (attributes, short child labels, length, parity).

Block content uses the monolith's own conversion rules (O80, see
``legacy_markdown.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnstile.operators.dom import (enclosing, enclosing_root, glued_words, has_marked_ancestor, page_window,
                                     subtree_sums, subtree_text)
from turnstile.operators.roles import LEGACY_MODEL, LEGACY_USER
from turnstile.session import materialize

# Fixed values (O22): UI tags.
UI_TAGS = ["script", "style", "meta", "link", "noscript", "iframe", "template", "svg", "header", "footer",
           "nav", "ms-chunk-tab", "ms-turn-chunk-header", "ms-footer-info", "ms-thought-chunk-header",
           "ms-turn-header"]
# Fixed values (O23): UI class pattern (any case).
UI_CLASS = (r"(?i)tooltip|popover|modal|menu|nav|sidebar|toolbar|notification|banner|cookie|overlay|"
            r"badge|avatar|copy-btn|action|button|share|like|rating")
# Fixed values (O24): whole-text UI labels (any case, anchored).
UI_TEXT_LABEL = (r"(?iu)^(model|user|thoughts?|thinking\.?|réflexion(\s+durant\s+[\d,]+\s*s)?|"
                 r"vous\s+avez\s+dit\s*:?|chatgpt\s+a\s+dit\s*:?|gemini\s+a\s+dit\s*:?|"
                 r"claude\s+a\s+dit\s*:?|assistant\s*:?|expand\s+to\s+view.*|"
                 r"chevron_right|[\d,]+\s*s)$")
# Fixed values (O27): role-signal words.
ROLE_SIGNAL = r"(?i)user|human|assistant|model|ai[-_]?message|turn|prompt|response|vous"
# Fixed values
DENSE_WORDS = 10
TEXT_TAGS = ["p", "h1", "h2", "h3", "h4", "ul", "ol", "pre"]
TEXT_TAG_SHARE = 0.4
CLASS_LIMIT, LABEL_LIMIT, CHILD_LABEL_LIMIT = 40, 80, 30

def _empty() -> Column:
    return F.array().cast("array<string>")


def _attrs_text() -> Column:
    """Attribute values as the monolith prints them (a class list prints as
    a Python list)."""
    cls = F.concat(F.lit("['"), F.array_join(F.coalesce("classes", _empty()), "', '"), F.lit("']"))
    vals = F.transform(F.map_entries(F.coalesce("attrs", F.create_map().cast("map<string,string>"))),
                       lambda e: F.when(e["key"] == "class", cls).otherwise(e["value"]))
    return F.array_join(vals, " ")


def _subtree_text(rows: DataFrame, targets: DataFrame, strip: bool) -> DataFrame:
    """Concatenated text of each target's subtree (targets: page_id, node_id)."""
    t = rows.filter((F.col("kind") == "text") & ~F.col("gone"))
    piece = F.regexp_replace("text", r"(?U)^\s+|\s+$", "") if strip else F.col("text")
    ends = targets.select("page_id", "node_id").join(rows.select("page_id", "node_id", "end"), ["page_id", "node_id"])
    return subtree_text(t, ends, piece)


def legacy_tree(m: DataFrame) -> DataFrame:
    """m (raw metrics table) -> nodes with ``gone`` (removed by O22-O24),
    ``lw`` (glued words), ``lchars`` (stripped chars) on the legacy tree."""
    w = page_window()
    tag = F.col("kind") == "tag"
    n = m.withColumn("_ui", tag & F.col("name").isin(*UI_TAGS))
    n = n.withColumn("_g1", F.col("_ui") | has_marked_ancestor(F.col("_ui"), w))
    vis = (F.col("kind") == "text") & ~F.col("_g1")
    chars = F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))
    s1 = subtree_sums(n, {"c": F.when(vis, chars).otherwise(0)})
    n = materialize(n.join(s1, ["page_id", "node_id"]).withColumnRenamed("sum_c", "_c1"))
    cls = F.array_join(F.coalesce("classes", _empty()), " ")
    by_class = tag & ~F.col("_g1") & cls.rlike(UI_CLASS) & (F.col("_c1") < CLASS_LIMIT)
    small = n.filter(tag & ~F.col("_g1") & (F.col("_c1") > 0) & (F.col("_c1") < LABEL_LIMIT))
    lab = _subtree_text(n.withColumn("gone", F.col("_g1")), small, strip=True)
    lab = lab.filter(F.col("txt").rlike(UI_TEXT_LABEL)).select("page_id", "node_id", F.lit(True).alias("_lab"))
    n = n.join(lab, ["page_id", "node_id"], "left")
    drop = by_class | F.coalesce(F.col("_lab"), F.lit(False))
    n = n.withColumn("_drop", drop)
    n = n.withColumn("gone", F.col("_g1") | F.col("_drop") | has_marked_ancestor(F.col("_drop"), w))
    live_text = (F.col("kind") == "text") & ~F.col("gone")
    s2 = subtree_sums(n, {"w": F.when(live_text, F.col("words")).otherwise(0),
                          "ne": F.when(live_text, F.col("nonempty")).otherwise(0),
                          "c": F.when(live_text, chars).otherwise(0)})
    n = n.join(s2, ["page_id", "node_id"])
    return materialize(n.select(*m.columns, "gone", glued_words(F.col("sum_w"), F.col("sum_ne")).alias("lw"),
                                F.col("sum_c").alias("lchars")))


def legacy_blocks(t: DataFrame) -> DataFrame:
    """O52 on the legacy tree -> (page_id, node_id, block_idx)."""
    tags = t.filter((F.col("kind") == "tag") & ~F.col("gone"))
    max_depth = tags.groupBy("page_id").agg(F.max("depth").alias("max_depth"))
    kids = tags.filter(F.col("parent_id").isNotNull())
    n_kids = kids.groupBy("page_id", "parent_id").agg(F.count("*").alias("n_kids"))
    dense = kids.filter(F.col("lw") > DENSE_WORDS)
    dw = Window.partitionBy("page_id", "parent_id").orderBy("node_id")
    dense = dense.withColumn("k", F.row_number().over(dw))
    first5 = dense.filter(F.col("k") <= 5)
    txt = _subtree_text(t, first5, strip=False)
    sig = (first5.join(txt, ["page_id", "node_id"], "left")
           .select("page_id", "parent_id",
                   F.concat_ws(" ", _attrs_text(), F.substring(F.coalesce("txt", F.lit("")), 1, 200))
                   .rlike(ROLE_SIGNAL).alias("sig"))
           .groupBy("page_id", "parent_id").agg(F.max(F.col("sig").cast("int")).alias("role_sig")))
    cls = F.array_join(F.coalesce("classes", _empty()), " ")
    per_cls = (dense.filter(F.size(F.coalesce("classes", _empty())) > 0)
               .groupBy("page_id", "parent_id", cls.alias("c")).agg(F.count("*").alias("k"))
               .groupBy("page_id", "parent_id").agg(F.max("k").alias("common")))
    g = dense.groupBy("page_id", "parent_id").agg(
        F.count("*").alias("n_dense"), F.sum(F.col("name").isin(*TEXT_TAGS).cast("int")).alias("n_text"))
    par = tags.select("page_id", F.col("node_id").alias("parent_id"), F.col("depth").alias("pdepth"))
    g = (g.join(n_kids, ["page_id", "parent_id"]).join(per_cls, ["page_id", "parent_id"], "left")
         .join(sig, ["page_id", "parent_id"], "left").join(par, ["page_id", "parent_id"])
         .join(max_depth, "page_id"))
    g = g.filter((F.col("n_kids") >= 2) & (F.col("n_dense") >= 2)
                 & ~(F.col("n_text") > F.col("n_dense") * TEXT_TAG_SHARE))
    ratio = F.col("pdepth") / F.col("max_depth")
    depth_bonus = 1 + 2 * F.greatest(F.lit(0.0), 1 - F.abs(ratio - 0.4) / 0.4)
    score = (F.col("n_dense") * F.coalesce("common", F.lit(1))
             * F.when(F.col("role_sig") == 1, 2).otherwise(1) * depth_bonus)
    g = g.withColumn("score", score).filter(F.col("score") > 0)
    bw = Window.partitionBy("page_id").orderBy(F.col("score").desc(), F.col("parent_id"))
    best = g.withColumn("r", F.row_number().over(bw)).filter(F.col("r") == 1).select("page_id", "parent_id")
    chosen = dense.join(best, ["page_id", "parent_id"]).select("page_id", "node_id")
    # no winning parent: every tag with a role signal, in document order
    rest = tags.join(best.select("page_id"), "page_id", "left_anti")
    rtxt = _subtree_text(t, rest.select("page_id", "node_id"), strip=False)
    fb = (rest.join(rtxt, ["page_id", "node_id"], "left")
          .filter(F.concat_ws(" ", _attrs_text(), F.substring(F.coalesce("txt", F.lit("")), 1, 200))
                  .rlike(ROLE_SIGNAL))
          .select("page_id", "node_id"))
    blocks = chosen.unionByName(fb)
    w = Window.partitionBy("page_id").orderBy("node_id")
    return blocks.withColumn("block_idx", (F.row_number().over(w) - 1).cast("int"))


def legacy_roles(t: DataFrame, blocks: DataFrame) -> DataFrame:
    """O62 vote on the DOM -> blocks + label (User/Model) + confidence."""
    b = blocks.join(t.select("page_id", "node_id", "attrs", "classes", "end", "lchars"), ["page_id", "node_id"])
    a = F.concat_ws(" ", _attrs_text())
    b = b.withColumn("au", a.rlike("(?i)" + LEGACY_USER).cast("int")).withColumn(
        "am", a.rlike("(?i)" + LEGACY_MODEL).cast("int"))
    # first ten descendant tags of each block with a short stripped text
    tags = (t.filter((F.col("kind") == "tag") & ~F.col("gone")).select("page_id", "node_id", "end", "lchars")
            .join(blocks.select("page_id", "node_id", "block_idx"), ["page_id", "node_id"], "left"))
    ex = (enclosing(tags, F.col("block_idx").isNotNull(), proper=True)
          .join(tags.select("page_id", "node_id", "lchars"), ["page_id", "node_id"])
          .select("page_id", F.col("node_id").alias("d"), "lchars", F.col("mark_id").alias("node_id"))
          .join(blocks.select("page_id", "node_id", "block_idx"), ["page_id", "node_id"]))
    ex = ex.withColumn("k", F.row_number().over(Window.partitionBy("page_id", "block_idx").orderBy("d")))
    short = ex.filter((F.col("k") <= 10) & (F.col("lchars") > 0) & (F.col("lchars") < CHILD_LABEL_LIMIT))
    stxt = _subtree_text(t, short.select("page_id", F.col("d").alias("node_id")).distinct(), strip=True)
    short = short.join(stxt.withColumnRenamed("node_id", "d"), ["page_id", "d"], "left")
    cl = short.groupBy("page_id", "block_idx").agg(
        F.sum(F.coalesce("txt", F.lit("")).rlike("(?i)" + LEGACY_USER).cast("int")).alias("cu"),
        F.sum(F.coalesce("txt", F.lit("")).rlike("(?i)" + LEGACY_MODEL).cast("int")).alias("cm"))
    b = b.join(cl, ["page_id", "block_idx"], "left")
    u = 3 * F.col("au") + 2 * F.coalesce("cu", F.lit(0))
    m = 3 * F.col("am") + 2 * F.coalesce("cm", F.lit(0))
    m = m + F.when(F.col("lchars") > 300, 1).otherwise(0)
    u = u + F.when((F.col("lchars") <= 300) & (F.col("lchars") < 150), 1).otherwise(0)
    tie = u == m
    u2 = u + F.when(tie & (F.col("block_idx") % 2 == 0), 1).otherwise(0)
    m2 = m + F.when(tie & (F.col("block_idx") % 2 != 0), 1).otherwise(0)
    tot = (u2 + m2).cast("double")
    return b.select("page_id", "node_id", "block_idx",
                    F.when(u2 > m2, F.lit("User")).otherwise(F.lit("Model")).alias("label"),
                    F.when(u2 > m2, u2 / tot).otherwise(m2 / tot).alias("confidence"))


def legacy_extract(pages: DataFrame, min_words: int = 3) -> DataFrame:
    """Strip noise -> detect -> vote -> convert -> keep blocks with at
    least ``min_words`` words (O26) -> (page_id, idx, label, confidence,
    content, marker)."""
    from turnstile.functions.text import py_words
    from turnstile.operators.extract import Options, prepare

    m, *_ = prepare(pages, Options(raw=True))
    t = legacy_tree(m)
    blocks = materialize(legacy_blocks(t))
    roles = legacy_roles(t, blocks)
    from turnstile.operators.legacy_markdown import legacy_to_markdown
    md = legacy_to_markdown(t, blocks)
    out = materialize(roles).join(materialize(md).hint("merge"), ["page_id", "block_idx"], "left").withColumn(
        "content", F.coalesce("content", F.lit("")))
    out = out.filter(py_words(F.col("content")) >= min_words)
    marker = F.when(F.col("confidence") < 0.7, F.concat(
        F.lit("<!-- role confidence: "), F.bround(F.col("confidence") * 100, 0).cast("int").cast("string"),
        F.lit("% -->")))
    w = Window.partitionBy("page_id").orderBy("block_idx")
    return out.select("page_id", (F.row_number().over(w) - 1).alias("idx"), "label", "confidence", "content",
                      marker.alias("marker"))


def render_legacy(turns: DataFrame) -> DataFrame:
    """Legacy document: ``## User|Model``, optional confidence comment, text, rule."""
    piece = F.concat(F.lit("## "), F.col("label"), F.lit("\n"), F.coalesce("marker", F.lit("")), F.lit("\n\n"),
                     F.col("content"), F.lit("\n\n---\n\n"))
    return turns.withColumn("piece", piece).groupBy("page_id").agg(
        F.expr("listagg(piece, '') WITHIN GROUP (ORDER BY idx)").alias("markdown"))


# Fixed values (O36): legacy diagram holders and their opening keywords.
LEGACY_DIAGRAM_CLASS = r"(?i)mermaid|code-block"
LEGACY_DIAGRAM_OPEN = (r"(?i)^(graph|flowchart|sequenceDiagram|classDiagram|stateDiagram|erDiagram|gantt|pie|"
                       r"gitGraph|journey|C4Context|mindmap|timeline)")
LEGACY_DIAGRAM_PREFIX = r"(?s)^.*?(\{.*?\}\}%%|%%\{.*?\}\}%%)"


def legacy_code_blocks(m: DataFrame) -> DataFrame:
    """The monolith's code protect, per page. ``pre``: language from the
    last descendant element carrying a ``language-x`` class (``mermaid`` in
    the pre's own class wins), text = its strings joined by newlines,
    stripped. ``div.mermaid|code-block`` whose stripped text opens with a
    diagram keyword: a fenced mermaid block, technical prefix removed.
    Returns (page_id, node_id, kind, lang, formatted)."""
    w = page_window()
    tag = F.col("kind") == "tag"
    n = m.withColumn("_pre_anc", has_marked_ancestor(tag & (F.col("name") == "pre"), w))
    pres = n.filter(tag & (F.col("name") == "pre") & ~F.col("_pre_anc"))
    # outermost ones don't nest: the last one that opened is the one around
    n = n.withColumn("_pre_rid", enclosing_root(tag & (F.col("name") == "pre") & ~F.col("_pre_anc"), w))
    inside = n.filter(F.col("_pre_rid").isNotNull() & (F.col("_pre_rid") != F.col("node_id")))
    desc = inside.filter(tag).select("page_id", F.col("node_id").alias("d"), "classes", F.col("_pre_rid").alias("node_id"))
    lang_of = F.try_element_at(F.filter(F.transform(F.coalesce("classes", _empty()),
                                                    lambda c: F.regexp_extract(c, r"^language-(\w+)", 1)),
                                        lambda x: x != ""), F.lit(1))
    langs = (desc.withColumn("lg", lang_of).filter(F.col("lg").isNotNull())
             .groupBy("page_id", "node_id").agg(F.max_by("lg", "d").alias("lg")))
    texts = (inside.filter(F.col("kind") == "text")
             .select("page_id", F.col("node_id").alias("src"), "text", F.col("_pre_rid").alias("node_id"))
             .groupBy("page_id", "node_id")
             .agg(F.expr("listagg(text, '\\n') WITHIN GROUP (ORDER BY src)").alias("txt")))
    mermaid_pre = F.array_join(F.coalesce("classes", _empty()), " ").contains("mermaid")
    code = (pres.select("page_id", "node_id", mermaid_pre.alias("mp"))
            .join(langs, ["page_id", "node_id"], "left").join(texts, ["page_id", "node_id"], "left"))
    lang = F.when(F.col("mp"), F.lit("mermaid")).otherwise(F.coalesce("lg", F.lit("")))
    body = F.regexp_replace(F.coalesce("txt", F.lit("")), r"(?U)^\s+|\s+$", "")
    code = code.select("page_id", "node_id", F.lit("code").alias("kind"), lang.alias("lang"),
                       F.concat(F.lit("```"), lang, F.lit("\n"), body, F.lit("\n```")).alias("formatted"))
    divs = n.filter(tag & (F.col("name") == "div") & ~F.col("_pre_anc")
                    & F.array_join(F.coalesce("classes", _empty()), " ").rlike(LEGACY_DIAGRAM_CLASS))
    dt = _subtree_text(n.withColumn("gone", F.lit(False)), divs.select("page_id", "node_id"), strip=False)
    dt = dt.withColumn("s", F.regexp_replace("txt", r"(?U)^\s+|\s+$", "")).filter(F.col("s").rlike(LEGACY_DIAGRAM_OPEN))
    clean = F.regexp_replace(F.regexp_replace("s", LEGACY_DIAGRAM_PREFIX, ""), r"(?U)^\s+|\s+$", "")
    merm = dt.select("page_id", "node_id", F.lit("mermaid").alias("kind"), F.lit("mermaid").alias("lang"),
                     F.concat(F.lit("```mermaid\n"), clean, F.lit("\n```")).alias("formatted"))
    return code.unionByName(merm)
