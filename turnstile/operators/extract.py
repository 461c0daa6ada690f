"""Validation, strategy choice and turn assembly.

``extract(pages, ...)`` is the whole page -> turns job:

    shred -> protect -> noise marks -> subtree metrics   (materialised once)
      -> rule probes and/or topology -> validation -> strategy per page
      -> roles -> Markdown events -> restore -> turns

Modes (O59): ``topo`` (default, forced clustering), ``heuristic`` (forced
probes), ``auto`` (probes if valid, else clustering if valid); any page left
without blocks falls back to its whole ``body``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from turnstile.operators import roles as R
from turnstile.operators.dom import enclosing, subtree_text
from turnstile.operators.markdown import to_markdown
from turnstile.operators.metrics import mark_noise, page_facts, with_metrics
from turnstile.operators.probes import heuristic_blocks
from turnstile.operators.predicates import source_votes, winning_source
from turnstile.operators.protect import close_entries, no_protect, protect, restore
from turnstile.operators.shred import given_ids, shred
from turnstile.operators.topology import signature_blocks, topo_blocks
from turnstile.session import co_partition_by_prefix, materialize

MIN_COVERAGE = 0.15


@dataclass
class Options:
    """Job parameters (the reference's extraction options)."""
    detector: str = "topo"        # topo | heuristic | auto | signature (spec'd variant)
    raw: bool = False             # O35: skip protect/restore
    tables: bool = True           # O79: tables off -> plain text
    numbered: bool = False        # O71: items of ordered lists are counted up
    data_latex: bool = False      # O91: formulas from data-latex attributes
    min_density: int = 3
    lookback: int = 3
    min_coverage: float = MIN_COVERAGE
    repeated: str = "least_hash"  # page that keeps a repeated page_id as its key (or longest)
    max_nodes: int | None = None  # O13: pages of more nodes go to the quarantine


@dataclass
class Extraction:
    """``page_id`` is a page's key: the given one, but where several pages
    have it (``shred.page_keys``); ``named`` puts the given one in its place."""
    turns: DataFrame          # page_id, idx, role, confidence, content, strategy
    protected: DataFrame      # page_id, key, ptype, raw, formatted, language, pos
    diagnostics: DataFrame    # page_id, strategy, blocks
    quarantine: DataFrame     # page_id, stage, error, html
    metrics: DataFrame        # dom_nodes + protect/noise flags + subtree metrics
    raw_content: DataFrame | None = None   # page_id, block_idx, content before restore
    versions: DataFrame | None = None      # page_id (key), given_id, page_hash of further pages of a page_id

    def named(self, df: DataFrame) -> DataFrame:
        return given_ids(df, self.versions)


def prepare(pages: DataFrame, opts: Options):
    co_partition_by_prefix(pages.sparkSession)
    nodes, quarantine, versions = shred(pages, opts.repeated, opts.max_nodes)
    pn, protected = (no_protect(nodes) if opts.raw else protect(nodes, opts.data_latex))
    m = materialize(with_metrics(mark_noise(pn), nodes))
    return m, close_entries(materialize(protected)), quarantine, versions


def validate(blocks: DataFrame, m: DataFrame, facts: DataFrame, variant: str,
             min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """O58 -> (page_id, valid). ``variant`` f: protected tree; n: de-noised."""
    b = blocks.join(m.select("page_id", "node_id", "classes", "depth",
                             F.col(f"dens_{variant}").alias("w"), F.col(f"code_{variant}").alias("code")),
                    ["page_id", "node_id"])
    u, mo = R.role_scores(F.array_join(F.coalesce("classes", F.array().cast("array<string>")), " "),
                          F.col("code") > 0)
    b = b.withColumn("r0", R.context_free_role(u, mo))
    g = b.groupBy("page_id").agg(F.count("*").alias("n"), F.count_distinct("r0").alias("n_roles"),
                                 F.sum("w").alias("bw"), F.min("depth").alias("d1"), F.max("w").alias("w1"))
    g = g.join(facts.select("page_id", "body_id", F.col(f"body_{variant}").alias("total")), "page_id", "left")
    total = F.col("total").cast("double")
    ok = (F.col("body_id").isNotNull() & (F.col("total") > 0)
          & ~((F.col("n") == 1) & (F.col("d1") < 3) & (F.col("w1") / total > 0.7))
          & ~((F.col("n") >= 2) & (F.col("n_roles") == 1))
          & (F.col("bw") / total >= min_coverage))
    return g.select("page_id", F.coalesce(ok, F.lit(False)).alias("valid"))


def choose_blocks(m: DataFrame, facts: DataFrame, opts: Options) -> DataFrame:
    """(page_id, node_id, strategy, nr) — nr: the noise subtrees were removed
    from this page's tree before conversion (the clustering pass ran)."""
    pages = facts.select("page_id")
    mode = opts.detector
    if mode == "heuristic":
        chosen = heuristic_blocks(m).select("page_id", "node_id", F.lit("forced_heuristic").alias("strategy"),
                                            F.lit(False).alias("nr"))
        fb_nr = F.lit(False)
    elif mode == "signature":
        chosen = signature_blocks(m).select("page_id", "node_id", F.lit("forced_signature").alias("strategy"),
                                            F.lit(True).alias("nr"))
        fb_nr = F.lit(True)
    elif mode == "topo":
        chosen = topo_blocks(m, facts, opts.min_density, opts.lookback).select(
            "page_id", "node_id", F.lit("forced_topo").alias("strategy"), F.lit(True).alias("nr"))
        fb_nr = F.lit(True)
    else:
        h = materialize(heuristic_blocks(m).select("page_id", "node_id"))
        hv = materialize(validate(h, m, facts, "f", opts.min_coverage).filter("valid").select("page_id"))
        h_ok = h.join(hv, "page_id", "left_semi")
        rest = pages.join(hv, "page_id", "left_anti")
        m_rest = m.join(rest, "page_id", "left_semi")
        t = materialize(topo_blocks(m_rest, facts, opts.min_density, opts.lookback))
        tv = validate(t, m, facts, "n", opts.min_coverage).filter("valid").select("page_id")
        t_ok = t.join(tv, "page_id", "left_semi")
        chosen = (h_ok.select("page_id", "node_id", F.lit("auto_heuristic").alias("strategy"),
                              F.lit(False).alias("nr"))
                  .unionByName(t_ok.select("page_id", "node_id", F.lit("auto_topological").alias("strategy"),
                                           F.lit(True).alias("nr"))))
        fb_nr = F.lit(True)
    empty = pages.join(chosen.select("page_id").distinct(), "page_id", "left_anti")
    fallback = (empty.join(facts.select("page_id", F.col("body_id").alias("node_id")), "page_id")
                .filter(F.col("node_id").isNotNull())
                .select("page_id", "node_id", F.lit("fallback_body").alias("strategy"), fb_nr.alias("nr")))
    return chosen.unionByName(fallback)


def assemble(m: DataFrame, blocks: DataFrame, protected: DataFrame, opts: Options) -> DataFrame:
    """O60-O63 + O67-O79 + O34: ordered turns with role, confidence and content."""
    w = Window.partitionBy("page_id").orderBy("node_id")
    b = blocks.withColumn("block_idx", (F.row_number().over(w) - 1).cast("int"))
    info = m.select("page_id", "node_id", "end", "classes", "code_f", "code_n")
    b = b.join(info, ["page_id", "node_id"])
    code = F.when(F.col("nr"), F.col("code_n")).otherwise(F.col("code_f")) > 0
    u, mo = R.role_scores(F.array_join(F.coalesce("classes", F.array().cast("array<string>")), " "), code)
    b = materialize(R.alternate(b.withColumn("strong", R.strong_role(u, mo)), ["page_id"], "block_idx"))
    md_raw = materialize(to_markdown(m, b.select("page_id", "block_idx", "node_id", "end", "nr"), tables=opts.tables, numbered=opts.numbered))
    md = md_raw if opts.raw else restore(md_raw, protected, "content", ("page_id", "block_idx"))
    turns = b.join(md, ["page_id", "block_idx"], "left")
    turns = turns.select("page_id", F.col("block_idx").alias("idx"), "node_id", "role", "confidence",
                         F.coalesce("content", F.lit("")).alias("content"), "strategy")
    return materialize(turns), md_raw


def extract(pages: DataFrame, opts: Options | None = None) -> Extraction:
    opts = opts or Options()
    m, protected, quarantine, versions = prepare(pages, opts)
    facts = materialize(page_facts(m))
    blocks = materialize(choose_blocks(m, facts, opts))
    turns, md_raw = assemble(m, blocks, protected, opts)
    diag = blocks.groupBy("page_id", "strategy").agg(F.count("*").alias("blocks"))
    return Extraction(turns, protected, diag, quarantine, m, md_raw, versions)


# Fixed values (O97): classes or test ids that mark a whole message.
MESSAGE_ANCHOR = r"(?i)message|turn"


def regroup(ex: Extraction, opts: Options | None = None) -> DataFrame:
    """Blocks that sit inside one message become one turn. The group key
    is the nearest ancestor-or-self whose class string or ``data-testid``
    names a message/turn (a block with none stays alone); raw block
    Markdown is concatenated in order, restored, and the role is inferred
    on the anchor, then alternation runs over the new order."""
    opts = opts or Options()
    m = ex.metrics
    t = ex.turns.select("page_id", F.col("idx").alias("block_idx"), "node_id")
    cls = F.array_join(F.coalesce("classes", F.array().cast("array<string>")), " ")
    anchor = (F.col("kind") == "tag") & (cls.rlike(MESSAGE_ANCHOR)
                                         | F.coalesce(F.col("attrs")["data-testid"], F.lit("")).rlike(MESSAGE_ANCHOR))
    is_block = m.join(t.select("page_id", "node_id", F.lit(True).alias("_block")), ["page_id", "node_id"], "left")
    near = enclosing(is_block, anchor, F.col("_block"), nearest=True)
    g = (t.join(near.select("page_id", "node_id", F.col("mark_id").alias("anchor")), ["page_id", "node_id"], "left")
         .withColumn("key", F.coalesce("anchor", "node_id"))
         .join(ex.raw_content, ["page_id", "block_idx"], "left"))
    merged = g.groupBy("page_id", "key").agg(
        F.min("block_idx").alias("first"),
        F.expr("listagg(coalesce(content, ''), '') WITHIN GROUP (ORDER BY block_idx)").alias("content"))
    w = Window.partitionBy("page_id").orderBy("first")
    merged = merged.withColumn("block_idx", (F.row_number().over(w) - 1).cast("int"))
    if not opts.raw:
        merged = restore(merged, ex.protected, "content", ("page_id", "block_idx"))
    info = m.select("page_id", F.col("node_id").alias("key"), "classes", "code_f", "code_n")
    merged = merged.join(info, ["page_id", "key"])
    u, mo = R.role_scores(F.array_join(F.coalesce("classes", F.array().cast("array<string>")), " "),
                          F.col("code_n") > 0)
    merged = R.alternate(merged.withColumn("strong", R.strong_role(u, mo)), ["page_id"], "block_idx")
    return merged.select("page_id", F.col("block_idx").alias("idx"), F.col("key").alias("node_id"), "role",
                         "confidence", "content")


# Turn rules by source: the turn's tag or attribute (one of them null), the
# attribute that names its role (else its first class; with no such attribute,
# its tag), tag or class of the content, and the roles kept.
SOURCE_TURN_RULES = [
    ("aistudio", "ms-chat-turn", None, "data-turn-role", "ms-text-chunk", None, "User,Model"),
    ("chatgpt", None, "data-message-author-role", "data-message-author-role", None, "markdown", "user,assistant"),
    ("gemini", "user-query", None, None, "message-content", None, "user-query"),
    ("gemini", "model-response", None, None, "message-content", None, "model-response")]
_RULE_SCHEMA = ("source string, turn_tag string, turn_attr string, role_attr string, content_tag string, "
                "content_class string, keep string")


def source_turns(pages: DataFrame, opts: Options | None = None) -> DataFrame:
    """O95 -> O90: each page's marks vote for the source that it was saved
    from, and the winner's rules read its turns. Content is the Markdown of
    the first element under a turn that the rule's tag or class names; a turn
    without one has none. -> page_id, version, idx, source, role, content."""
    opts = opts or Options()
    spark = pages.sparkSession
    m, protected, _, versions = prepare(pages, opts)
    source = winning_source(source_votes(m, _keyed_urls(pages, versions)))
    rules = F.broadcast(spark.createDataFrame(SOURCE_TURN_RULES, _RULE_SCHEMA))
    yes = lambda c: F.coalesce(c, F.lit(False))
    tags = (m.filter(F.col("kind") == "tag").select("page_id", "node_id", "end", "name", "attrs", "classes")
            .join(source.select("page_id", "source"), "page_id"))
    is_turn = yes(F.col("name") == F.col("turn_tag")) | yes(F.array_contains(F.map_keys("attrs"), F.col("turn_attr")))
    label = F.coalesce(F.col("attrs")[F.col("role_attr")],
                       F.when(F.col("role_attr").isNotNull(), F.try_element_at(F.col("classes"), F.lit(1))).otherwise(F.col("name")))
    turns = (tags.join(rules, "source").filter(is_turn).withColumn("label", label)
             .filter(F.array_contains(F.split("keep", ","), F.col("label")))
             .select("page_id", "source", F.col("node_id").alias("turn_id"), "content_tag", "content_class", "label"))
    names = {r[4] for r in SOURCE_TURN_RULES if r[4]}
    styles = {r[5] for r in SOURCE_TURN_RULES if r[5]}
    may = F.col("name").isin(*names) | yes(F.arrays_overlap("classes", F.array(*map(F.lit, sorted(styles)))))
    marked = tags.join(turns.select("page_id", F.col("turn_id").alias("node_id"), F.lit(True).alias("_turn")).distinct(),
                       ["page_id", "node_id"], "left")
    held = (enclosing(marked, F.col("_turn"), may, proper=True)
            .select("page_id", "node_id", F.col("mark_id").alias("turn_id")).join(tags.drop("source"), ["page_id", "node_id"])
            .join(turns, ["page_id", "turn_id"])
            .filter(yes(F.col("name") == F.col("content_tag")) | yes(F.array_contains("classes", F.col("content_class")))))
    first = held.groupBy("page_id", "turn_id", "source", "label").agg(F.min("node_id").alias("node_id"))
    w = Window.partitionBy("page_id").orderBy("turn_id")
    blocks = materialize(first.withColumn("block_idx", (F.row_number().over(w) - 1).cast("int"))
                         .withColumn("nr", F.lit(False)))
    md = to_markdown(m, blocks.select("page_id", "block_idx", "node_id", "nr"), tables=opts.tables, numbered=opts.numbered)
    if not opts.raw:
        md = restore(md, protected, "content", ("page_id", "block_idx"))
    out = blocks.join(md, ["page_id", "block_idx"], "left").select(
        "page_id", F.col("block_idx").alias("idx"), "source", F.col("label").alias("role"),
        F.coalesce("content", F.lit("")).alias("content"))
    return given_ids(materialize(out), versions)


def _keyed_urls(pages: DataFrame, versions: DataFrame | None) -> DataFrame:
    """page_id (key), url of each page; pages of one id may differ in url as well."""
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.xxhash64("html").alias("_h"))
    if versions is None:
        return urls.drop("_h")
    v = versions.select(F.col("page_id").alias("_key"), F.col("given_id").alias("page_id"), F.col("page_hash").alias("_h"))
    return (urls.join(v, ["page_id", "_h"], "left")
            .select(F.coalesce("_key", "page_id").alias("page_id"), "url"))


def clean_text(m: DataFrame, roots: DataFrame) -> DataFrame:
    """The stripped, non-empty strings of each root's subtree joined by a
    single space. roots(page_id, node_id) -> (page_id, node_id, clean_text)."""
    t = m.filter((F.col("kind") == "text") & ~F.col("claimed"))
    t = t.select("page_id", "node_id", F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("t")).filter(F.col("t") != "")
    targets = roots.select("page_id", "node_id").join(m.select("page_id", "node_id", "end"), ["page_id", "node_id"])
    out = subtree_text(t, targets, F.col("t"), " ").withColumnRenamed("txt", "clean_text")
    return materialize(roots.select("page_id", "node_id").join(out, ["page_id", "node_id"], "left").select(
        "page_id", "node_id", F.coalesce("clean_text", F.lit("")).alias("clean_text")))


def hr_group_turns(pages: DataFrame, opts: Options | None = None) -> DataFrame:
    """O44 ("flux", spec only in the reference): under the parent with most
    direct ``hr`` children, the siblings between two separators form one
    turn; group id = running count of ``hr`` over the siblings. Each sibling
    is converted, then a group's Markdown is concatenated in order."""
    from turnstile.operators.probes import _tags
    opts = opts or Options()
    m, protected, *_ = prepare(pages, opts)
    t = _tags(m)
    hrs = t.filter(F.col("name") == "hr").groupBy("page_id", "parent_id").agg(F.count("*").alias("n"))
    best = hrs.groupBy("page_id").agg(
        F.min_by("parent_id", F.struct((-F.col("n")).alias("a"), F.col("parent_id").alias("b"))).alias("parent_id"))
    kids = t.filter(~F.col("name").isin("script", "style")).join(best, ["page_id", "parent_id"])
    w = Window.partitionBy("page_id").orderBy("node_id")
    kids = kids.withColumn("grp", F.sum((F.col("name") == "hr").cast("int")).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    kids = kids.filter(F.col("name") != "hr")
    blocks = materialize(kids.select("page_id", "node_id", "grp", "classes", "code_f")
                         .withColumn("block_idx", (F.row_number().over(w) - 1).cast("int")))
    md = to_markdown(m, blocks.select("page_id", "block_idx", "node_id", F.lit(False).alias("nr")),
                     tables=opts.tables, numbered=opts.numbered)
    g = (blocks.join(md, ["page_id", "block_idx"], "left").groupBy("page_id", "grp")
         .agg(F.expr("listagg(coalesce(content, ''), '') WITHIN GROUP (ORDER BY block_idx)").alias("content"),
              F.min_by(F.struct("classes", "code_f"), "block_idx").alias("first")))
    gw = Window.partitionBy("page_id").orderBy("grp")
    g = g.withColumn("block_idx", (F.row_number().over(gw) - 1).cast("int"))
    if not opts.raw:
        g = restore(g, protected, "content", ("page_id", "block_idx"))
    u, mo = R.role_scores(F.array_join(F.coalesce("first.classes", F.array().cast("array<string>")), " "),
                          F.col("first.code_f") > 0)
    g = R.alternate(g.withColumn("strong", R.strong_role(u, mo)), ["page_id"], "block_idx")
    return materialize(g.select("page_id", F.col("block_idx").alias("idx"), "role", "confidence", "content"))
