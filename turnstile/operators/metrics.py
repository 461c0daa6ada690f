"""O14/O15 noise marks and O17/O18 subtree metrics on the protected tree.

Two variants of every subtree metric are computed in the same pass:
``_f`` on the full protected tree and ``_n`` with noise subtrees removed
(the topology pass works on the de-noised tree, the rule probes do not).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnstile.operators.dom import glued_words, has_marked_ancestor, page_window, subtree_sums

# Fixed values (O14/O15): noise roles and class pattern.
NOISE_ROLES = ["dialog", "banner", "navigation"]
NOISE_CLASS = r"(?i)cookie|modal|overlay|popup"
# Fixed values (O48): tags that make a block "rich"; (O60): code-like tags.
RICH_TAGS = ["pre", "code", "table", "blockquote", "li", "h1", "h2"]
CODE_TAGS = ["pre", "code", "annotation", "math"]


def mark_noise(pnodes: DataFrame) -> DataFrame:
    """Adds ``in_noise``: the node lies in (or is) a noise subtree."""
    tag = (F.col("kind") == "tag") & ~F.col("claimed")
    by_role = F.coalesce(F.col("attrs")["role"].isin(*NOISE_ROLES), F.lit(False))
    by_class = F.exists(F.coalesce("classes", F.array().cast("array<string>")),
                        lambda c: c.rlike(NOISE_CLASS)) & (F.col("name") != "body")
    root = F.coalesce(tag & (by_role | by_class), F.lit(False))
    return pnodes.withColumn("_nroot", root).withColumn(
        "in_noise", F.col("_nroot") | has_marked_ancestor(F.col("_nroot"), page_window())).drop("_nroot")


def with_metrics(pnodes: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """pnodes (+in_noise) -> same rows + subtree metrics for both variants.
    ``nodes``: the rows that ``pnodes`` was made from; the columns it added go
    through the sums' checkpoint then, and its steps don't run again."""
    live = ~F.col("claimed")
    vis = (F.col("kind") == "text") & live
    keyed = F.col("key").isNotNull() & live
    w = F.when(vis, F.col("words")).when(keyed, 1).otherwise(0)
    ne = F.when(vis, F.col("nonempty")).when(keyed, 1).otherwise(0)
    tag = (F.col("kind") == "tag") & live
    rich = tag & F.col("name").isin(*RICH_TAGS)
    code = tag & F.col("name").isin(*CODE_TAGS)
    keep = ~F.col("in_noise")
    contrib = {
        "w_f": w, "ne_f": ne, "k_f": keyed.cast("int"), "r_f": rich.cast("int"), "c_f": code.cast("int"),
        "w_n": F.when(keep, w).otherwise(0), "ne_n": F.when(keep, ne).otherwise(0),
        "k_n": (keyed & keep).cast("int"), "r_n": (rich & keep).cast("int"),
        "c_n": (code & keep).cast("int"),
    }
    if nodes is None:
        out = pnodes.join(subtree_sums(pnodes, contrib), ["page_id", "node_id"])
    else:
        added = [c for c in pnodes.columns if c not in nodes.columns]
        out = nodes.join(subtree_sums(pnodes, contrib, carry=added), ["page_id", "node_id"])
    self_rich = rich.cast("long")
    self_code = code.cast("long")
    return out.select(
        *pnodes.columns,
        glued_words(F.col("sum_w_f"), F.col("sum_ne_f")).alias("dens_f"),
        glued_words(F.col("sum_w_n"), F.col("sum_ne_n")).alias("dens_n"),
        F.col("sum_ne_f").alias("ne_f"), F.col("sum_ne_n").alias("ne_n"),
        F.col("sum_k_f").alias("keys_f"), F.col("sum_k_n").alias("keys_n"),
        (F.col("sum_r_f") - self_rich).alias("rich_f"), (F.col("sum_r_n") - self_rich).alias("rich_n"),
        (F.col("sum_c_f") - self_code).alias("code_f"), (F.col("sum_c_n") - self_code).alias("code_n"))


def page_facts(m: DataFrame) -> DataFrame:
    """Per page: first ``body`` and its word counts (both variants), and the
    document's word count (used when a page has no body)."""
    is_body = F.coalesce((F.col("kind") == "tag") & (F.col("name") == "body") & ~F.col("claimed"), F.lit(False))
    is_doc = F.col("node_id") == 0
    body = F.struct(F.col("node_id").alias("body_id"), F.col("dens_f").alias("body_f"),
                    F.col("dens_n").alias("body_n"), F.col("end").alias("body_end"))
    # both in one pass over the rows
    facts = m.filter(is_body | is_doc).groupBy("page_id").agg(
        F.max(F.when(is_doc, F.col("dens_f"))).alias("doc_f"), F.min_by(body, F.when(is_body, F.col("node_id"))).alias("b"))
    return facts.select("page_id", "doc_f", "b.*")
