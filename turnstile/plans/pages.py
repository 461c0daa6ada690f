"""Queries over the ``pages`` table (raw web pages).

* token scans without a tree (O05, O14/O22 regex form, O70, O75) — pure
  Catalyst string functions, checked against the same regexes in SQL;
* the DOM pipeline over real pages (O04, O13, O51, O59, O86, O88) — rows
  only: these pages hold no chat, so the result is the strategy the engine
  falls to, not a known truth.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from turnstile.functions.text import py_strip
from turnstile.operators.dom import enclosing, subtree_text
from turnstile.operators.extract import Options, extract, prepare
from turnstile.operators.metrics import page_facts
from turnstile.operators.predicates import SOURCE_RULES
from turnstile.operators.shred import given_ids
from turnstile.operators.topology import candidates, fingerprint, topo_blocks, uncovered
from turnstile.sources.tables import read_table
from turnstile.session import materialize

# Regexes shared with the SQL oracles (same meaning in both engines)
NOISE_BLOCKS = (r"(?s)<nav\b.*?</nav>|<header\b.*?</header>|<footer\b.*?</footer>"
                r"|<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->")
RAWTEXT_BLOCKS = r"(?s)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
START_TAG = r"<([a-zA-Z][a-zA-Z0-9-]*)"
LINK = r"""(?s)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>"""
HEADING = r"(?s)<h([1-6])[^>]*>(.*?)</h[1-6]>"
ANY_TAG = r"<[^>]+>"
EDGE_SPACE = r"^\s+|\s+$"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", "url", "html")


def _strip(c):
    return F.regexp_replace(c, EDGE_SPACE, "")


def page_tokens(spark, sf_dir):
    """Start-tag names in document order, raw-text blocks skipped."""
    p = _pages(spark, sf_dir)
    tags = F.regexp_extract_all(F.regexp_replace("html", RAWTEXT_BLOCKS, ""), F.lit(START_TAG), 1)
    return p.select("page_id", F.posexplode(tags).alias("pos", "tag")).select(
        "page_id", "pos", F.lower("tag").alias("tag"))


def page_tag_counts(spark, sf_dir):
    return page_tokens(spark, sf_dir).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def page_noise_removed(spark, sf_dir):
    """O14/O22 regex form: nav, header, footer, script, style and comments cut."""
    p = _pages(spark, sf_dir)
    clean = F.regexp_replace("html", NOISE_BLOCKS, "")
    return p.select("page_id", F.length("html").alias("chars_before"), F.length(clean).alias("chars_after"))


def page_links_md(spark, sf_dir):
    """``[text](href)``; a missing half gives the other half."""
    p = _pages(spark, sf_dir)
    z = F.arrays_zip(F.regexp_extract_all("html", F.lit(LINK), 1).alias("href"),
                     F.regexp_extract_all("html", F.lit(LINK), 2).alias("inner"))
    e = p.select("page_id", F.posexplode(z).alias("pos", "l"))
    t = _strip(F.regexp_replace(F.col("l.inner"), ANY_TAG, ""))
    h = F.col("l.href")
    md = F.when((h != "") & (t != ""), F.concat(F.lit("["), t, F.lit("]("), h, F.lit(")"))) \
          .when(t != "", t).otherwise(h)
    return e.select("page_id", "pos", md.alias("link_md"))


def page_headings_md(spark, sf_dir):
    """``#`` x level, then the heading text."""
    p = _pages(spark, sf_dir)
    z = F.arrays_zip(F.regexp_extract_all("html", F.lit(HEADING), 1).alias("lvl"),
                     F.regexp_extract_all("html", F.lit(HEADING), 2).alias("inner"))
    e = p.select("page_id", F.posexplode(z).alias("pos", "h"))
    t = _strip(F.regexp_replace(F.col("h.inner"), ANY_TAG, ""))
    return e.select("page_id", "pos",
                    F.concat(F.repeat(F.lit("#"), F.col("h.lvl").cast("int")), F.lit(" "), t).alias("heading_md"))


def page_strategy(spark, sf_dir, detector: str = "auto"):
    """O59 over real pages: winning strategy and block count per page."""
    ex = extract(_pages(spark, sf_dir), Options(detector=detector))
    return ex.named(ex.turns.groupBy("page_id", "strategy").agg(
        F.count("*").alias("n_turns"), F.sum(F.length("content")).alias("md_chars")))


def page_turns(spark, sf_dir):
    """O63 with the default (forced clustering) detector over real pages."""
    ex = extract(_pages(spark, sf_dir), Options(detector="topo"))
    return ex.named(ex.turns).select("page_id", "version", "idx", "role", "confidence", "strategy", "content")


def page_quarantine(spark, sf_dir):
    """Pages the shred could not parse (normally none)."""
    ex = extract(_pages(spark, sf_dir), Options(detector="topo"))
    return ex.quarantine.select("page_id", "stage", "error")


def page_density(spark, sf_dir):
    """O17/O18 from the DOM: body words (protected tree, before and after
    noise removal) and the deepest node per page."""
    m, _, _, versions = prepare(_pages(spark, sf_dir), Options())
    f = page_facts(m)
    d = m.groupBy("page_id").agg(F.max("depth").alias("max_depth"), F.count("*").alias("n_nodes"))
    return given_ids(f.join(d, "page_id").select("page_id", "body_f", "body_n", "max_depth", "n_nodes"), versions)


def cluster_top10(spark, sf_dir, k: int = 10):
    """The k best clusters per page with size, density, the fingerprint of
    the first member and of its parent, and the first 50 characters of its text."""
    m, _, _, versions = prepare(_pages(spark, sf_dir), Options())
    facts = materialize(page_facts(m))
    _, members, scores = topo_blocks(m, facts, with_scores=True)
    w = Window.partitionBy("page_id").orderBy(F.col("score").desc(), "cluster_id")
    top = scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    first = members.groupBy("page_id", "cluster_id").agg(F.min("node_id").alias("node_id"))
    s = materialize(top.join(first, ["page_id", "cluster_id"]).join(
        m.select("page_id", "node_id", "parent_id", "end"), ["page_id", "node_id"]))
    fp = fingerprint(m)
    text = subtree_text(m.filter((F.col("kind") == "text") & ~F.col("claimed") & ~F.col("in_noise")), s, F.col("text"))
    snippet = F.substring(F.regexp_replace(py_strip(F.coalesce("txt", F.lit(""))), r"(?U)\s+", " "), 1, 50)
    s = (s.join(fp, ["page_id", "node_id"], "left")
         .join(fp.select("page_id", F.col("node_id").alias("parent_id"), F.col("fingerprint").alias("parent")), ["page_id", "parent_id"], "left")
         .join(text, ["page_id", "node_id"], "left"))
    return given_ids(s.select("page_id", "rank", "cluster_id", "n", "avg_density", "score", "fingerprint", "parent",
                              snippet.alias("snippet")), versions)


def clusters_uncovered(spark, sf_dir):
    """The clusters of each page that no higher-scoring one covers."""
    m, _, _, versions = prepare(_pages(spark, sf_dir), Options())
    _, members, scores = topo_blocks(m, materialize(page_facts(m)), with_scores=True)
    return given_ids(uncovered(members, candidates(m), scores), versions)


def node_paths(spark, sf_dir, term: str = "the"):
    """Text nodes that contain ``term``, with the name and classes of the
    element that holds each, and the tag path above it."""
    m, _, _, versions = prepare(_pages(spark, sf_dir), Options(raw=True))
    tag = F.col("kind") == "tag"
    hits = (F.col("kind") == "text") & F.col("text").contains(term)
    names = m.filter(tag).select("page_id", F.col("node_id").alias("mark_id"), "name", "classes")
    up = enclosing(m, tag, hits, proper=True).join(names, ["page_id", "mark_id"])
    return given_ids(up.groupBy("page_id", "node_id").agg(
        F.max_by("name", "level").alias("name"), F.array_join(F.max_by("classes", "level"), " ").alias("classes"),
        F.expr("listagg(name, ' -> ') WITHIN GROUP (ORDER BY level)").alias("tag_path")), versions)


_CLEAN_SQL = r"regexp_replace(html, '(?s)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g')"
_NOISE_SQL = (r"regexp_replace(html, '(?s)<nav\b.*?</nav>|<header\b.*?</header>|<footer\b.*?</footer>"
              r"|<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g')")
_LINK_SQL = r"""'(?s)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'"""
_HEAD_SQL = r"'(?s)<h([1-6])[^>]*>(.*?)</h[1-6]>'"
_STRIP = r"regexp_replace(regexp_replace(%s, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g')"

ORACLE = {
    "page_tokens": f"""
        SELECT page_id, pos, lower(tag) AS tag FROM (
          SELECT page_id, unnest(generate_series(0, len(arr) - 1)) AS pos, unnest(arr) AS tag
          FROM (SELECT page_id, regexp_extract_all({_CLEAN_SQL}, '<([a-zA-Z][a-zA-Z0-9-]*)', 1) AS arr
                FROM pages))""",
    "page_tag_counts": f"""
        SELECT page_id, lower(tag) AS tag, count(*) AS n FROM (
          SELECT page_id, unnest(regexp_extract_all({_CLEAN_SQL}, '<([a-zA-Z][a-zA-Z0-9-]*)', 1)) AS tag
          FROM pages) GROUP BY page_id, lower(tag)""",
    "page_noise_removed": f"""
        SELECT page_id, length(html) AS chars_before, length({_NOISE_SQL}) AS chars_after FROM pages""",
    "page_links_md": f"""
        SELECT page_id, pos,
               CASE WHEN href <> '' AND t <> '' THEN '[' || t || '](' || href || ')'
                    WHEN t <> '' THEN t ELSE href END AS link_md
        FROM (SELECT page_id, pos, href, {_STRIP % 'inr'} AS t FROM (
                SELECT page_id, unnest(generate_series(0, len(hs) - 1)) AS pos, unnest(hs) AS href,
                       unnest(ins) AS inr
                FROM (SELECT page_id, regexp_extract_all(html, {_LINK_SQL}, 1) AS hs,
                             regexp_extract_all(html, {_LINK_SQL}, 2) AS ins FROM pages)))""",
    "page_headings_md": f"""
        SELECT page_id, pos, repeat('#', CAST(lvl AS INTEGER)) || ' ' || {_STRIP % 'inr'} AS heading_md
        FROM (SELECT page_id, unnest(generate_series(0, len(ls) - 1)) AS pos, unnest(ls) AS lvl,
                     unnest(ins) AS inr
              FROM (SELECT page_id, regexp_extract_all(html, {_HEAD_SQL}, 1) AS ls,
                           regexp_extract_all(html, {_HEAD_SQL}, 2) AS ins FROM pages))""",
}

QUERIES = {
    "page_tokens": page_tokens,
    "page_tag_counts": page_tag_counts,
    "page_noise_removed": page_noise_removed,
    "page_links_md": page_links_md,
    "page_headings_md": page_headings_md,
    "page_strategy": page_strategy,
    "page_turns": page_turns,
    "page_quarantine": page_quarantine,
    "page_density": page_density,
    "cluster_top10": cluster_top10,
    "clusters_uncovered": clusters_uncovered,
    "node_paths": node_paths,
}


def stream_parity(spark, sf_dir, n_files: int = 2):
    """§2.10: the pages table lands as files in a shared folder (under
    ``spark.checkpoint.dir``), a file stream extracts them micro-batch by
    micro-batch; the result has the batch job's rows."""
    import os
    import uuid

    from turnstile.session import ensure_checkpoint_dir
    from turnstile.streaming.stream import run_to_completion

    base = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    src = os.path.join(base, "in")
    n_files = max(n_files, spark.sparkContext.defaultParallelism)  # each is written by one task
    (_pages(spark, sf_dir).repartition(n_files, "page_id").write.parquet(src))
    out = run_to_completion(spark, src, os.path.join(base, "out"), os.path.join(base, "ckpt"),
                            Options(detector="topo"))
    return out.select("page_id", "idx", "role", "confidence", "strategy", "content")


QUERIES["stream_parity"] = stream_parity


# ---- legacy UI tags (O22, regex form), source rules (O95), node predicates --------
# Fixed values (O22): legacy UI tags removed with their content.
LEGACY_UI_TAGS = ["script", "style", "meta", "link", "noscript", "iframe", "template", "svg", "header",
                  "footer", "nav", "ms-chunk-tab", "ms-turn-chunk-header", "ms-footer-info",
                  "ms-thought-chunk-header", "ms-turn-header"]
_VOID_UI = ["meta", "link"]
LEGACY_UI_BLOCKS = "(?s)" + "|".join(
    [rf"<{t}\b[^>]*>" for t in _VOID_UI]
    + [rf"<{t}\b[^>]*>.*?</{t}>" for t in LEGACY_UI_TAGS if t not in _VOID_UI])


def page_legacy_ui_removed(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return p.select("page_id", F.length(F.regexp_replace("html", LEGACY_UI_BLOCKS, "")).alias("chars_after"))


def page_source(spark, sf_dir):
    from turnstile.operators.predicates import source_of
    return source_of(spark, _pages(spark, sf_dir))


def node_predicates(spark, sf_dir):
    """O20, O21, O89, O94 per page: UI elements, empty tags, scrubbed
    attributes, and class similarity of each tag with its parent."""
    from turnstile.operators.predicates import class_jaccard, is_empty_node, is_ui_element, scrub_attrs
    m, *_ = prepare(_pages(spark, sf_dir), Options(raw=True))
    t = m.filter(F.col("kind") == "tag")
    par = t.select("page_id", F.col("node_id").alias("parent_id"), F.col("classes").alias("pcls"))
    t = t.join(par, ["page_id", "parent_id"], "left")
    return materialize(t.groupBy("page_id").agg(
        F.sum(is_ui_element(F.col("classes"), F.col("name")).cast("int")).alias("n_ui"),
        F.sum(is_empty_node(F.col("ne_f")).cast("int")).alias("n_empty"),
        F.sum(F.size(scrub_attrs(F.col("attrs")))).alias("n_attrs_kept"),
        F.round(F.avg(class_jaccard(F.coalesce("classes", F.array().cast("array<string>")),
                                    F.coalesce("pcls", F.array().cast("array<string>")))), 6).alias("mean_jaccard")))


_RULES_SQL = ", ".join(f"('{h}', '{s}')" for h, s in SOURCE_RULES)
ORACLE["page_legacy_ui_removed"] = (
    "SELECT page_id, length(regexp_replace(html, '" + LEGACY_UI_BLOCKS + "', '', 'g')) AS chars_after FROM pages")
ORACLE["page_source"] = f"""
    SELECT p.page_id, p.host, coalesce(r.source, 'generic') AS source
    FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)) AS host
          FROM pages) p
    LEFT JOIN (VALUES {_RULES_SQL}) r(host, source) ON p.host = r.host"""
QUERIES["page_legacy_ui_removed"] = page_legacy_ui_removed
QUERIES["page_source"] = page_source
QUERIES["node_predicates"] = node_predicates


def legacy_turns(spark, sf_dir):
    """E3 (legacy monolith) over the real pages: noise strip, parent scoring,
    role vote, minimum words, confidence marker."""
    from turnstile.operators.legacy import legacy_extract
    return legacy_extract(_pages(spark, sf_dir))


def rt_legacy(spark, sf_dir):
    """E3 over the data-attribute chat pages built from conversations."""
    from turnstile.operators.legacy import legacy_extract
    from turnstile.plans.synth_pages import chat_pages
    return legacy_extract(chat_pages(spark, sf_dir, "data_attr")).withColumnRenamed("page_id", "conv_id")


QUERIES["legacy_turns"] = legacy_turns
QUERIES["rt_legacy"] = rt_legacy


def page_markup_ratio(spark, sf_dir):
    """Visible text characters over source characters, per tag; the page
    row carries the body's ratio and the mean over its tags."""
    from turnstile.operators.dom import subtree_sums
    m, *_ = prepare(_pages(spark, sf_dir), Options(raw=True))
    chars = F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))
    s = subtree_sums(m, {"c": F.when(F.col("kind") == "text", chars).otherwise(0)})
    t = m.join(s, ["page_id", "node_id"]).filter(F.col("kind") == "tag")
    span = (F.col("src_end") - F.col("src_start")).cast("double")
    t = t.withColumn("ratio", F.when(span > 0, F.col("sum_c") / span))
    return t.groupBy("page_id").agg(
        F.round(F.max(F.when(F.col("name") == "body", F.col("ratio"))), 6).alias("body_ratio"),
        F.round(F.avg("ratio"), 6).alias("mean_tag_ratio"))


QUERIES["page_markup_ratio"] = page_markup_ratio


def page_diagnostics(spark, sf_dir, detector: str = "auto", date: str = "1970-01-01T00:00:00"):
    """Run facts per page — winning strategy, block count, protected
    entries by type, the options as a map, version and date (a job parameter)."""
    import turnstile
    opts = Options(detector=detector)
    ex = extract(_pages(spark, sf_dir), opts)
    prot = ex.protected.groupBy("page_id").agg(
        F.count("*").alias("n_protected"),
        F.sum((F.col("ptype") == "code").cast("int")).alias("n_code"),
        F.sum((F.col("ptype") == "mermaid").cast("int")).alias("n_mermaid"),
        F.sum((F.col("ptype") == "math").cast("int")).alias("n_math"))
    out = ex.diagnostics.join(prot.hint("merge"), "page_id", "left").fillna(0, ["n_protected", "n_code", "n_mermaid", "n_math"])
    options = F.create_map(*[F.lit(str(x)) for kv in sorted(asdict(opts).items()) for x in kv])
    return ex.named(out).withColumn("options", options).withColumn("date", F.lit(date)).withColumn(
        "engine", F.lit(turnstile.__version__))


def locate_nodes(spark, sf_dir, attr: str = "class", value: str = "ad", k: int = 5):
    """Which cluster holds each node carrying ``attr`` (= ``value``), the
    first ``k`` per page; a null cluster means the node is in none. The
    reference looks for ``data-section-id``; the driver pages carry none, so
    the default here is ``class=ad``."""
    m, *_ = prepare(_pages(spark, sf_dir), Options())
    facts = materialize(page_facts(m))
    _, members, _ = topo_blocks(m, facts, with_scores=True)
    has = F.col("attrs")[attr].isNotNull()
    if value is not None:
        has = has & F.exists(F.split(F.coalesce(F.col("attrs")[attr], F.lit("")), " "), lambda x: x == value)
    marked = m.filter((F.col("kind") == "tag") & has)
    w = Window.partitionBy("page_id").orderBy("node_id")
    marked = marked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return materialize(marked.select("page_id", "node_id", "rank")
                       .join(members.select("page_id", "node_id", "cluster_id"), ["page_id", "node_id"], "left")
                       .select("page_id", F.col("node_id").alias("marked"), "rank", "cluster_id"))


QUERIES["page_diagnostics"] = page_diagnostics
QUERIES["locate_nodes"] = locate_nodes


def legacy_documents(spark, sf_dir):
    """O81 (legacy labels) + O66: one legacy Markdown document per page, a
    confidence comment under turns voted with less than 0.7."""
    from turnstile.operators.legacy import legacy_extract, render_legacy
    return render_legacy(legacy_extract(_pages(spark, sf_dir)))


QUERIES["legacy_documents"] = legacy_documents
