"""Protect code, diagrams and formulas before detection, restore after.

Each protected subtree ("root") is replaced by one placeholder word: its
descendants are flagged ``claimed`` and the root row carries ``key``. The
placeholder map is the ``protected`` table ``(page_id, key, ptype, raw,
formatted, pos)``. Priority is code > mermaid > math; a node inside an
earlier root is never claimed twice (O32). Keys use our own prefix and 16
hex digits of md5 to keep collisions negligible (O28).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnstile.functions.text import py_strip
from turnstile.operators.dom import (enclosing, enclosing_root, has_marked_ancestor, page_window, subtree_text)
from turnstile.session import materialize

KEY_PREFIX = "__TSK_"
KEY_HEX = 16
KEY_PATTERN = r"__TSK_[A-Z]+_[0-9a-f]{16}__"

# Fixed values (O30): diagram keywords recognised at a line start.
MERMAID_KEYWORDS = ["graph", "flowchart", "sequenceDiagram", "classDiagram", "stateDiagram",
                    "erDiagram", "gantt", "pie", "gitGraph", "journey", "C4Context", "mindmap",
                    "timeline"]
MERMAID_LINE = r"(?imdU)^\s*(?:\}\}%%|%%\{.*?\}%%)?\s*(" + "|".join(MERMAID_KEYWORDS) + r")\b"
MERMAID_PREFIX = r"(?d)^(?:\}\}%%|%%\{.*?\}%%)"
STRUCTURAL = ["div", "article", "section", "table"]
TEX_ENCODING = "application/x-tex"


def make_key(kind: str, raw: Column) -> Column:
    return F.concat(F.lit(f"{KEY_PREFIX}{kind}_"), F.substring(F.md5(raw), 1, KEY_HEX), F.lit("__"))


def _ordered_text(rows: DataFrame, group: list[str], text: str = "t") -> DataFrame:
    return rows.groupBy(*group).agg(
        F.expr(f"listagg({text}, '') WITHIN GROUP (ORDER BY node_id)").alias("txt"))


def protect(nodes: DataFrame, data_latex: bool = False) -> tuple[DataFrame, DataFrame]:
    """Returns (pnodes, protected). ``pnodes`` = nodes + ``key``, ``ptype``,
    ``claimed``. Nodes are read once; every step is a page-ordered window,
    a ``page_id``-keyed aggregate or an equi-join."""
    w = page_window()
    # only what protect reads is carried through its checkpoints (less I/O
    # at scale); the result joins the flags back onto the full node rows
    keep_attrs = F.map_filter("attrs", lambda k, v: k.isin("encoding", "display", "data-latex"))
    n = nodes.select("page_id", "node_id", "kind", "name", keep_attrs.alias("attrs"), "classes", "end", "text")
    # ---- code: outermost pre ------------------------------------------
    is_pre = (F.col("kind") == "tag") & (F.col("name") == "pre")
    n = n.withColumn("_pre_anc", has_marked_ancestor(is_pre, w))
    code_root = is_pre & ~F.col("_pre_anc")
    n = n.withColumn("_code_rid", enclosing_root(code_root, w))
    in_code = F.col("_code_rid").isNotNull()
    claimed_code = in_code & (F.col("node_id") != F.col("_code_rid"))
    live = ~claimed_code
    # a div of no structural element: the next one on the page lies behind it
    structural = n.filter((F.col("kind") == "tag") & live & F.col("name").isin(*STRUCTURAL))
    leaf = (structural.select("page_id", "node_id", "end", "name", F.lead("node_id").over(w).alias("_next"))
            .filter((F.col("name") == "div") & (F.col("_next").isNull() | (F.col("_next") > F.col("end"))))
            .select("page_id", "node_id", F.lit(True).alias("_leaf")))
    n = n.join(leaf, ["page_id", "node_id"], "left")
    # ---- mermaid candidates: div/p outside code, not structural -----------
    eligible = (F.col("kind") == "tag") & ~in_code & ((F.col("name") == "p") | F.col("_leaf").isNotNull())
    n = n.withColumn("_mcand", eligible)  # the joined text is tested below: a keyword may span text nodes
    n = materialize(n.withColumn("_in_mcand", has_marked_ancestor(F.col("_mcand"), w)).drop("_leaf", "_pre_anc"))
    code_nodes = n.filter(in_code)
    first_code = (code_nodes.filter((F.col("name") == "code") & (F.col("node_id") != F.col("_code_rid")))
                  .groupBy("page_id", "_code_rid")
                  .agg(F.min_by(F.struct("node_id", "end", "classes"), "node_id").alias("c")))
    code_txt = (code_nodes.filter(F.col("kind") == "text")
                .join(first_code, ["page_id", "_code_rid"], "left")
                .filter(F.col("c").isNull() | F.col("node_id").between(F.col("c.node_id"), F.col("c.end")))
                .select("page_id", "_code_rid", "node_id", F.col("text").alias("t")))
    code_txt = _ordered_text(code_txt, ["page_id", "_code_rid"])
    roots = (code_nodes.filter(F.col("node_id") == F.col("_code_rid"))
             .select("page_id", "_code_rid")
             .join(code_txt, ["page_id", "_code_rid"], "left")
             .join(first_code, ["page_id", "_code_rid"], "left"))
    lang = F.coalesce(F.replace(F.try_element_at(F.filter("c.classes", lambda x: x.startswith("language-")), F.lit(1)),
                                F.lit("language-"), F.lit("")), F.lit(""))
    raw = F.coalesce(F.col("txt"), F.lit(""))
    code_p = roots.select(
        "page_id", F.col("_code_rid").alias("root_id"), F.lit("code").alias("ptype"), raw.alias("raw"),
        F.concat(F.lit("``` "), lang, F.lit("\n"), raw, F.lit("\n```")).alias("formatted"),
        make_key("CODE", raw).alias("key"), lang.alias("language"))
    code_p = materialize(code_p)

    # ---- mermaid: candidates with a keyword line ---------------------------
    # text stream of the code-protected tree: code roots read as their key
    code_key = code_p.select("page_id", F.col("root_id").alias("node_id"), F.col("key").alias("_ckey"))
    cands = n.filter("_mcand").select("page_id", F.col("node_id").alias("anc"), "end")
    texts = n.filter((F.col("_mcand") | F.col("_in_mcand")) & (F.col("kind") == "text") & live).select("page_id", "node_id", "text")
    keyed = (n.filter(F.col("_in_mcand") & (F.col("node_id") == F.col("_code_rid"))).select("page_id", "node_id")
             .join(code_key, ["page_id", "node_id"]).withColumnRenamed("_ckey", "text"))
    ctext = (subtree_text(texts.unionByName(keyed), cands.withColumnRenamed("anc", "node_id"), F.col("text"))
             .withColumnRenamed("node_id", "anc"))
    mc = cands.join(ctext, ["page_id", "anc"], "left").withColumnRenamed("anc", "node_id")
    mc = mc.withColumn("_match", F.coalesce(F.col("txt"), F.lit("")).rlike(MERMAID_LINE))
    mc = mc.withColumn("_m_anc", has_marked_ancestor(F.col("_match"), w))
    mroots = materialize(mc.filter(F.col("_match") & ~F.col("_m_anc")))
    mraw = py_strip(F.regexp_replace(F.col("txt"), MERMAID_PREFIX, ""))
    merm_p = mroots.select(
        "page_id", F.col("node_id").alias("root_id"), F.lit("mermaid").alias("ptype"), mraw.alias("raw"),
        F.concat(F.lit("```mermaid\n"), mraw, F.lit("\n```")).alias("formatted"),
        make_key("MERM", mraw).alias("key"), F.lit("mermaid").alias("language"))
    n = n.join(mroots.select("page_id", "node_id", F.lit(True).alias("_mroot")), ["page_id", "node_id"], "left")
    n = n.withColumn("_in_merm", has_marked_ancestor(F.coalesce(F.col("_mroot"), F.lit(False)), w))
    n = n.withColumn("_ann_rid", enclosing_root(
        (F.col("kind") == "tag") & (F.col("name") == "annotation")
        & (F.col("attrs")["encoding"] == TEX_ENCODING) & ~in_code & ~F.col("_in_merm")
        & F.col("_mroot").isNull(), w))
    # what formulas are made of; the rest of a page isn't carried on
    is_math = F.coalesce(F.col("name") == "math", F.lit(False))
    is_katex = F.coalesce(F.array_contains("classes", "katex"), F.lit(False))
    n = materialize(n.filter(F.col("_ann_rid").isNotNull() | is_math | is_katex | F.col("attrs")["data-latex"].isNotNull()))

    # ---- math: TeX annotations outside code and mermaid -----------------
    is_ann = F.coalesce(F.col("_ann_rid") == F.col("node_id"), F.lit(False))
    ann_txt = _ordered_text(n.filter(F.col("_ann_rid").isNotNull() & (F.col("kind") == "text"))
                            .select("page_id", "_ann_rid", "node_id", F.col("text").alias("t")),
                            ["page_id", "_ann_rid"])
    anns = n.filter(is_ann).select("page_id", F.col("node_id").alias("ann_id"))
    info = n.select("page_id", "node_id", F.col("attrs")["display"].alias("display"), "end")
    holders = n.select("page_id", "node_id", "end", "name", "classes", F.col("attrs")["display"].alias("display"),
                       is_ann.alias("_ann"))

    def nearest(mark: Column, name: str) -> DataFrame:
        return enclosing(holders, mark, F.col("_ann"), proper=True, nearest=True).select(
            "page_id", F.col("node_id").alias("ann_id"), F.col("mark_id").alias(name))
    near = (anns.join(nearest(is_math, "m"), ["page_id", "ann_id"], "left")
            .join(nearest(is_katex, "k"), ["page_id", "ann_id"], "left")
            .join(info.select("page_id", F.col("node_id").alias("m"), "display"), ["page_id", "m"], "left"))
    araw = py_strip(F.coalesce(F.col("txt"), F.lit("")))
    is_block = F.coalesce(F.col("display") == "block", F.lit(False))
    mt = (near.join(ann_txt.withColumnRenamed("_ann_rid", "ann_id"), ["page_id", "ann_id"], "left")
          .select("page_id", "ann_id", F.coalesce("k", "m", "ann_id").alias("node_id"),
                  araw.alias("raw"), is_block.alias("blk")))
    # A formula carried in a data-latex attribute is another math input;
    # the element itself is the target (inline form)
    dl = n.filter((F.col("kind") == "tag") & F.col("attrs")["data-latex"].isNotNull() & ~in_code
                  & ~F.col("_in_merm") & F.col("_mroot").isNull())
    dl = dl.select("page_id", F.col("node_id").alias("ann_id"), "node_id",
                   py_strip(F.col("attrs")["data-latex"]).alias("raw"), F.lit(False).alias("blk"))
    # off by default; where such an element holds an annotation, that one counts
    if data_latex:
        own = F.col("attrs")["data-latex"].isNotNull()
        above = enclosing(n.select("page_id", "node_id", "end", "attrs", is_ann.alias("_ann")), own, F.col("_ann"), proper=True)
        mt = mt.unionByName(dl.join(above.select("page_id", F.col("mark_id").alias("node_id")), ["page_id", "node_id"], "left_anti"))
    mt = mt.groupBy("page_id", "node_id").agg(F.min_by(F.struct("raw", "blk"), "ann_id").alias("a"))
    mt = mt.join(info.select("page_id", "node_id", "end"), ["page_id", "node_id"])
    mt = mt.withColumn("_t_anc", has_marked_ancestor(F.lit(True), w)).filter(~F.col("_t_anc"))
    math_p = mt.select(
        "page_id", F.col("node_id").alias("root_id"), F.lit("math").alias("ptype"), F.col("a.raw").alias("raw"),
        F.when(F.col("a.blk"), F.concat(F.lit("$$\n"), F.col("a.raw"), F.lit("\n$$")))
        .otherwise(F.concat(F.lit("$"), F.col("a.raw"), F.lit("$"))).alias("formatted"),
        make_key("MATH", F.col("a.raw")).alias("key"), F.lit(None).cast("string").alias("language"))

    allp = materialize(code_p.unionByName(merm_p).unionByName(math_p))
    # ---- final claims: outermost root wins --------------------------------
    rk = allp.select("page_id", F.col("root_id").alias("node_id"), F.col("key").alias("_key"),
                     F.col("ptype").alias("_ptype"))
    out = nodes.join(rk, ["page_id", "node_id"], "left")
    is_root = F.col("_key").isNotNull()
    out = out.withColumn("claimed", has_marked_ancestor(is_root, w))
    out = (out.withColumn("key", F.when(~F.col("claimed"), F.col("_key")))
           .withColumn("ptype", F.when(~F.col("claimed"), F.col("_ptype")))
           .drop("_key", "_ptype"))
    # One entry per (page, key); later formatting wins, first position kept
    protected = allp.groupBy("page_id", "key").agg(
        F.max_by(F.struct("ptype", "raw", "formatted", "language"), "root_id").alias("e"),
        F.min("root_id").alias("pos"))
    protected = protected.select("page_id", "key", "e.ptype", "e.raw", "e.formatted", "e.language", "pos")
    return out, protected


def no_protect(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O35 ``raw`` mode: skip protect and restore."""
    out = (nodes.withColumn("key", F.lit(None).cast("string"))
           .withColumn("ptype", F.lit(None).cast("string"))
           .withColumn("claimed", F.lit(False)))
    empty = nodes.sparkSession.createDataFrame(
        [], "page_id long, key string, ptype string, raw string, formatted string, language string, pos int")
    return out, empty


def close_entries(protected: DataFrame, most: int = 40) -> DataFrame:
    """The map with no key left in ``formatted`` that it has an entry for: a
    protected block may hold keys of others, those again, and so on.

    Each round puts into the entries that hold keys what these keys stand for
    so far, so the depth that is resolved doubles; only such entries are
    touched, and turns are then restored in one pass. Entries can't hold one
    another in a circle, as a key is a hash of the text; ``most`` rounds would
    resolve any depth."""
    known = protected.select("page_id", "key")

    def holding(df: DataFrame) -> DataFrame:
        keys = df.filter(F.col("formatted").rlike(KEY_PATTERN)).select(
            "page_id", F.col("key").alias("holder"), F.explode(F.regexp_extract_all("formatted", F.lit(KEY_PATTERN), 0)).alias("key"))
        return keys.join(known, ["page_id", "key"]).select("page_id", F.col("holder").alias("key")).distinct()
    for _ in range(most):
        held = materialize(holding(protected))
        if held.isEmpty():
            break
        still = protected.join(held, ["page_id", "key"], "left_semi").select(*protected.columns)
        done = protected.join(held, ["page_id", "key"], "left_anti").select(*protected.columns)
        protected = materialize(done.unionByName(restore(still, protected, "formatted", ("page_id", "key"))))
    return protected


def restore(df: DataFrame, protected: DataFrame, col: str = "content",
            keys: tuple[str, ...] = ("page_id", "block_idx")) -> DataFrame:
    """Replace every placeholder in ``col`` by its formatted content
    (``close_entries`` has seen to keys within that). Rows without
    placeholders pass straight through; the others are split at the keys,
    joined to the map on ``(page_id, key)`` and re-assembled in order. Unknown
    keys are left as they are."""
    keys = list(keys)
    own = [f"_own_{k}" for k in keys]
    has = F.col(col).contains(KEY_PREFIX) & F.col(col).rlike(KEY_PATTERN)
    plain = df.filter(~has)
    withk = df.filter(has)
    segs = withk.select("page_id", *[F.col(k).alias(o) for k, o in zip(keys, own)], F.split(F.col(col), KEY_PATTERN).alias("segs"),
                        F.regexp_extract_all(F.col(col), F.lit(KEY_PATTERN), 0).alias("ks"))
    ex = segs.select("page_id", *own, "segs", F.posexplode("ks").alias("i", "key"))
    ex = ex.join(protected.select("page_id", "key", "formatted"), ["page_id", "key"], "left")
    ex = ex.select(*own, "segs", "i",
                   F.concat(F.coalesce("formatted", "key"), F.col("segs")[F.col("i") + 1]).alias("piece"))
    back = ex.groupBy(*own).agg(
        F.first(F.col("segs")[0]).alias("head"),
        F.expr("listagg(piece, '') WITHIN GROUP (ORDER BY i)").alias("tail"))
    back = back.select(*[F.col(o).alias(k) for k, o in zip(keys, own)], F.concat("head", "tail").alias(col))
    return plain.unionByName(withk.drop(col).join(back, keys).select(*df.columns))
