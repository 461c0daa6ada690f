"""Structural clustering of candidate nodes and cluster scoring.

* candidates (O16): tags outside noise, not page-frame tags, with glued word
  count >= ``min_density`` or holding a placeholder;
* merge (O47): the one truly sequential step. Per page, candidates in
  document order join the newest of the last ``lookback`` clusters whose
  last member is compatible (O46). Rows are hash-partitioned by page and
  sorted by (page_id, node_id); one ``mapInArrow`` pass per partition runs
  the fold with O(n) state reset at each page boundary (no per-group
  setup); only the few columns the pair test needs cross into Python;
* score (O48), vertical dedupe (O49) and champion (O50) are aggregates,
  equi-joins and a page window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from turnstile.operators.dom import enclosing
from turnstile.session import materialize

# Fixed values
FRAME_TAGS = ["html", "body", "script", "style", "head", "header", "footer", "nav"]
TEXT_TAGS = frozenset(["p", "li", "ul", "ol", "h1", "h2", "h3", "h4", "blockquote", "span", "strong",
                       "em", "code", "pre"])
UNSTABLE_CLASS = r"\d{4,}"
UNSTABLE_CLASS_SIG = r"\d{4,}|[a-f0-9]{6,}"

MERGE_SCHEMA = "page_id long, node_id int, cluster_id int"


def candidates(m: DataFrame, min_density: int = 3) -> DataFrame:
    t = m.filter((F.col("kind") == "tag") & ~F.col("claimed") & ~F.col("in_noise")
                 & ~F.col("name").isin(*FRAME_TAGS))
    return t.filter((F.col("dens_n") >= min_density) | (F.col("keys_n") > 0))


def _compatible(a, b) -> bool:
    """O46 pair test; ``a`` is the last member of a cluster, ``b`` the new
    candidate (later in document order). Tuples: (node_id, end, parent,
    grandparent, name, classes)."""
    if b[0] <= a[1]:                      # b inside a
        return False
    pa, pb, ga, gb = a[2], b[2], a[3], b[3]
    if not (pa == pb or pb == ga or pa == gb or (ga is not None and ga == gb)):
        return False
    ca, cb = a[5], b[5]
    if ca and cb and not (ca & cb):
        return False
    if a[4] != b[4] and not (a[4] in TEXT_TAGS and b[4] in TEXT_TAGS):
        return False
    return True


def _fold_partition(lookback: int):
    """Sequential merge over one partition whose rows are grouped by page and
    sorted by (page_id, node_id): the state resets at every page boundary,
    so no per-group setup is paid and each row is visited once."""
    import pyarrow as pa

    out_schema = pa.schema([("page_id", pa.int64()), ("node_id", pa.int32()), ("cluster_id", pa.int32())])

    def run(batches):
        page = None
        tails: list[tuple[int, tuple]] = []
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            out_p, out_n, out_c = [], [], []
            for i in range(batch.num_rows):
                pid = cols["page_id"][i]
                if pid != page:
                    page, tails = pid, []
                cls = cols["cls"][i]
                cur = (cols["node_id"][i], cols["end"][i], cols["parent_id"][i], cols["gparent_id"][i],
                       cols["name"][i], frozenset(cls) if cls else frozenset())
                hit = None
                for j in range(len(tails) - 1, max(len(tails) - lookback, 0) - 1, -1):
                    if _compatible(tails[j][1], cur):
                        hit = j
                        break
                if hit is None:
                    tails.append((len(tails), cur))
                    cid = len(tails) - 1
                else:
                    cid = tails[hit][0]
                    tails[hit] = (cid, cur)
                out_p.append(pid)
                out_n.append(cur[0])
                out_c.append(cid)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_p, pa.int64()), pa.array(out_n, pa.int32()), pa.array(out_c, pa.int32())],
                schema=out_schema)
    return run


def merge_clusters(cands: DataFrame, lookback: int = 3) -> DataFrame:
    """(page_id, node_id, cluster_id); cluster ids follow creation order.

    Rows are hash-partitioned by page and sorted by (page_id, node_id), then
    one ``mapInArrow`` pass per partition runs the fold; only the seven
    columns the pair test needs cross into Python."""
    nparts = int(cands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = cands.select(
        "page_id", "node_id", "end", "parent_id",
        "gparent_id", "name",
        F.filter(F.coalesce("classes", F.array().cast("array<string>")),
                 lambda c: ~c.rlike(UNSTABLE_CLASS)).alias("cls"))
    slim = slim.repartition(nparts, "page_id").sortWithinPartitions("page_id", "node_id")
    return slim.mapInArrow(_fold_partition(lookback), MERGE_SCHEMA)


def score_clusters(members: DataFrame, cands: DataFrame, facts: DataFrame) -> DataFrame:
    """O48 score per (page_id, cluster_id). Page words are taken before noise
    removal (body, else the whole document)."""
    c = members.join(cands.select("page_id", "node_id", "dens_n", "depth", "rich_n", "keys_n"),
                     ["page_id", "node_id"])
    g = c.groupBy("page_id", "cluster_id").agg(
        F.count("*").alias("n"), F.sum("dens_n").alias("sum_d"), F.sum("depth").alias("sum_depth"),
        F.sum((F.col("rich_n") > 0).cast("int")).alias("n_rich"),
        F.max((F.col("keys_n") > 0).cast("int")).alias("has_key"))
    g = g.join(facts.select("page_id", F.coalesce("body_f", "doc_f").alias("total_words")), "page_id")
    n = F.col("n").cast("double")
    base = (n * (F.col("sum_d") / n)) * (F.col("sum_depth") / n / 10.0) * F.least(
        F.lit(1.0) + 0.5 * F.col("n_rich"), F.lit(3.0))
    base = F.when(F.col("has_key") == 1, base * 1.5).otherwise(base)
    wrapper = ((F.col("n") == 1) & (F.col("total_words") > 50)
               & (F.try_divide(F.col("sum_d").cast("double"), F.col("total_words").cast("double")) > 0.8))
    score = F.when(wrapper, base / 10.0).otherwise(base)
    return g.select("page_id", "cluster_id", "n", (F.col("sum_d") / n).alias("avg_density"),
                    score.alias("score"))


def uncovered(members: DataFrame, cands: DataFrame, scores: DataFrame) -> DataFrame:
    """(page_id, cluster_id, n, score) without the clusters that a
    higher-scoring cluster covers (each member lies in one of its members).
    A page's best cluster is never among those, so only reports need this."""
    mem = members.join(cands.select("page_id", "node_id", "end"), ["page_id", "node_id"])
    up = (enclosing(mem, F.lit(True), proper=True).select("page_id", "node_id", F.col("mark_id").alias("anc"))
          .join(members, ["page_id", "node_id"]))
    other = members.select("page_id", F.col("node_id").alias("anc"), F.col("cluster_id").alias("c2"))
    cover = (up.join(other, ["page_id", "anc"]).filter(F.col("c2") != F.col("cluster_id"))
             .groupBy("page_id", "cluster_id", "c2").agg(F.count_distinct("node_id").alias("k")))
    s1 = scores.select("page_id", "cluster_id", "n", "score")
    s2 = scores.select("page_id", F.col("cluster_id").alias("c2"), F.col("score").alias("score2"))
    red = (cover.join(s1, ["page_id", "cluster_id"]).filter(F.col("k") == F.col("n"))
           .join(s2, ["page_id", "c2"]).filter(F.col("score2") > F.col("score"))
           .select("page_id", "cluster_id").distinct())
    return s1.join(red, ["page_id", "cluster_id"], "left_anti")


def champions(members: DataFrame, scores: DataFrame) -> DataFrame:
    """Members of the best cluster per page (ties: the earlier cluster)."""
    rank = F.struct(F.coalesce(-F.col("score"), F.lit(float("inf"))).alias("s"), F.col("cluster_id").alias("c"))
    best = scores.groupBy("page_id").agg(F.min_by("cluster_id", rank).alias("cluster_id"))
    return members.join(best, ["page_id", "cluster_id"])


def topo_blocks(m: DataFrame, facts: DataFrame, min_density: int = 3, lookback: int = 3,
                with_scores: bool = False):
    cands = materialize(candidates(m, min_density))
    members = materialize(merge_clusters(cands, lookback))
    scores = materialize(score_clusters(members, cands, facts))
    best = champions(members, scores).select("page_id", "node_id")
    if with_scores:
        return best, members, scores
    return best


def fingerprint(m: DataFrame) -> DataFrame:
    """``d<depth>|tag|first three stable classes, sorted``."""
    stable = F.filter(F.coalesce("classes", F.array().cast("array<string>")),
                      lambda c: ~c.rlike(UNSTABLE_CLASS_SIG))
    sig = F.concat(F.lit("d"), F.col("depth").cast("string"), F.lit("|"), F.col("name"), F.lit("|"),
                   F.array_join(F.array_sort(F.slice(stable, 1, 3)), "+"))
    return m.filter(F.col("kind") == "tag").select("page_id", "node_id", sig.alias("fingerprint"))


# ---- signature clustering (O53-O57, the spec'd variant; detector "signature") ----
SIG_MIN_DENSITY = 3


def signatures(m: DataFrame) -> DataFrame:
    """``name[classes](child:count,...)role=..;testid=..`` per tag, with
    dynamic class suffixes removed and child tags counted by name."""
    t = m.filter((F.col("kind") == "tag") & ~F.col("claimed") & ~F.col("in_noise"))
    counts = (t.filter(F.col("parent_id").isNotNull())
              .groupBy("page_id", "parent_id", "name").agg(F.count("*").alias("k"))
              .groupBy("page_id", "parent_id")
              .agg(F.map_from_entries(F.collect_list(F.struct("name", "k"))).alias("kids")))
    counts = counts.withColumnRenamed("parent_id", "node_id")
    t = t.join(counts, ["page_id", "node_id"], "left")
    norm = F.filter(F.transform(F.coalesce("classes", F.array().cast("array<string>")),
                                lambda c: F.regexp_replace(F.regexp_replace(c, r"[_-]?[a-f0-9]{6,}", ""),
                                                           r"[_-]?\d{4,}", "")),
                    lambda c: c != "")
    kids = F.coalesce("kids", F.create_map().cast("map<string,bigint>"))
    kid_sig = F.array_join(F.transform(F.array_sort(F.map_entries(kids)),
                                       lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    role = F.coalesce(F.col("attrs")["role"], F.lit(""))
    tid = F.coalesce(F.col("attrs")["data-testid"], F.lit(""))
    attr_sig = F.when((role != "") | (tid != ""), F.concat(F.lit("role="), role, F.lit(";testid="), tid)) \
                .otherwise(F.lit(""))
    sig = F.concat(F.col("name"), F.lit("["), F.array_join(F.array_sort(norm), "+"), F.lit("]("), kid_sig,
                   F.lit(")"), attr_sig)
    return t.select("page_id", "node_id", "parent_id", "name", "dens_n", sig.alias("sig"),
                    F.array_sort(norm).alias("ncls"), kids.alias("kids"))


def _compatible_sig(a_name, a_cls, a_kids, b_name, b_cls, b_kids):
    """Same tag, overlapping classes, child counts within one."""
    close = F.forall(F.map_values(F.map_zip_with(
        a_kids, b_kids, lambda k, v1, v2: F.abs(F.coalesce(v1, F.lit(0)) - F.coalesce(v2, F.lit(0))) <= 1)),
        lambda ok: ok)
    return (a_name == b_name) & F.arrays_overlap(a_cls, b_cls) & close


def signature_blocks(m: DataFrame) -> DataFrame:
    """O54-O57 -> (page_id, node_id) of the best signature cluster."""
    s = materialize(signatures(m))
    # O55 positions among the parent's tag children
    pos = Window.partitionBy("page_id", "parent_id").orderBy("node_id")
    s = s.withColumn("ord", F.row_number().over(pos))
    cand = s.filter(F.col("dens_n") > SIG_MIN_DENSITY)
    # Same parent and signature, at least two
    cl = cand.groupBy("page_id", "parent_id", "sig").agg(
        F.count("*").alias("n"), F.min("node_id").alias("first"), F.first("name").alias("cname"),
        F.first("ncls").alias("ccls"), F.first("kids").alias("ckids"))
    cl = cl.filter(F.col("n") >= 2)
    # Merge a cluster into the previous one under the same parent when compatible
    w = Window.partitionBy("page_id", "parent_id").orderBy("first")
    prev = [F.lag(c).over(w) for c in ("cname", "ccls", "ckids")]
    cl = cl.withColumn("_new", F.coalesce(~_compatible_sig(prev[0], prev[1], prev[2], F.col("cname"),
                                                          F.col("ccls"), F.col("ckids")), F.lit(True)))
    cl = cl.withColumn("grp", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    mem = cand.join(cl.select("page_id", "parent_id", "sig", "grp"), ["page_id", "parent_id", "sig"])
    gw = Window.partitionBy("page_id", "parent_id", "grp").orderBy("ord")
    mem = mem.withColumn("gap", F.col("ord") - F.lag("ord").over(gw))
    sc = mem.groupBy("page_id", "parent_id", "grp").agg(
        F.count("*").alias("n"), F.avg("dens_n").alias("avg_d"), F.var_pop("gap").alias("var_gap"),
        F.min("node_id").alias("first"))
    reg = F.when(F.col("n") < 3, F.lit(1.0)).otherwise(1.0 / (1.0 + F.coalesce("var_gap", F.lit(0.0))))
    sc = sc.withColumn("score", F.col("n") * F.col("avg_d") * reg)
    bw = Window.partitionBy("page_id").orderBy(F.col("score").desc(), "first")
    best = sc.withColumn("r", F.row_number().over(bw)).filter(F.col("r") == 1).select("page_id", "parent_id", "grp")
    sigs = mem.join(best, ["page_id", "parent_id", "grp"]).select("page_id", "parent_id", "sig").distinct()
    # Short siblings with a winning signature are re-admitted
    return s.join(sigs, ["page_id", "parent_id", "sig"]).select("page_id", "node_id")
