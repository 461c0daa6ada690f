"""Rule probes and their waterfall, as set operations.

Each probe is ``metrics -> (page_id, node_id, priority)``; all four run in
one pass over the tag rows and the waterfall keeps, per page, the lowest
priority that produced blocks (``min`` over a page window). Probes see the
protected tree without noise removal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from turnstile.session import materialize

# Fixed values
TESTID_PATTERN = r"(?i)conversation|message|turn"
AUTHOR_ROLE_ATTR = "data-message-author-role"
DATA_MESSAGE_PREFIX = "data-message"
DATA_DROP_TAGS = ["button", "svg", "path", "script", "form", "nav"]
USER_CLASS = r"(?i)\b(user|human|you)(-|_)?message\b"
BOT_CLASS = r"(?i)\b(assistant|model|ai|bot|agent)(-|_)?(message|turn)\b"
HR_SKIP = ["hr", "script", "style"]
REPEAT_TAGS = ["div", "article", "section"]
REPEAT_MIN_WORDS = 5
REPEAT_MIN_BLOCKS = 4

PRIORITY = {"data_attr": 1, "semantic_class": 2, "separator": 3, "repetition": 4}
CONFIDENCE = {"data_attr": 0.95, "semantic_class": 0.8, "separator": 0.7, "repetition": 0.4}
MIN_CONFIDENCE = 0.4


def _tags(m: DataFrame) -> DataFrame:
    return m.filter((F.col("kind") == "tag") & ~F.col("claimed"))


def _marks() -> F.Column:
    """The attributes that the probes read."""
    return F.map_filter("attrs", lambda k, v: (k == "data-testid") | k.startswith(DATA_MESSAGE_PREFIX))


def _page_count(cond) -> F.Column:
    return F.sum(F.when(cond, 1).otherwise(0)).over(Window.partitionBy("page_id"))


def probe_data_attr(t: DataFrame) -> DataFrame:
    t1 = F.coalesce(F.col("attrs")["data-testid"].rlike(TESTID_PATTERN), F.lit(False))
    t2 = F.map_contains_key("attrs", AUTHOR_ROLE_ATTR)
    t3 = F.exists(F.map_keys("attrs"), lambda k: k.startswith(DATA_MESSAGE_PREFIX))
    tier = F.when(t1, 1).when(t2, 2).when(t3, 3)
    d = t.select("page_id", "node_id", "name", tier.alias("tier")).filter(F.col("tier").isNotNull())
    w = Window.partitionBy("page_id")
    d = d.withColumn("ptier", F.min("tier").over(w)).filter(F.col("tier") == F.col("ptier"))
    d = d.withColumn("n", F.count("*").over(w)).filter(F.col("n") >= 2)
    return d.filter(~F.col("name").isin(*DATA_DROP_TAGS)).select("page_id", "node_id")


def probe_semantic_class(t: DataFrame) -> DataFrame:
    cls = F.array_join(F.coalesce("classes", F.array().cast("array<string>")), " ")
    strong = cls.rlike(USER_CLASS) | cls.rlike(BOT_CLASS)
    msg = (F.exists(F.coalesce("classes", F.array().cast("array<string>")),
                    lambda c: F.lower(c) == "message") | (F.lower(cls) == "message"))
    d = t.select("page_id", "node_id", strong.alias("s"), msg.alias("m"),
                 F.lower(cls).contains("list").alias("has_list"))
    d = d.filter(F.col("s") | F.col("m"))
    w = Window.partitionBy("page_id")
    d = d.withColumn("ns", _page_count(F.col("s"))).withColumn("nm", _page_count(F.col("m")))
    pick = F.col("s") | ((F.col("ns") == 0) & (F.col("nm") >= 2) & F.col("m") & ~F.col("has_list"))
    d = d.filter(pick).withColumn("n", F.count("*").over(w)).filter(F.col("n") >= 2)
    return d.select("page_id", "node_id")


def probe_separator(t: DataFrame) -> DataFrame:
    hrs = t.filter(F.col("name") == "hr").groupBy("page_id", "parent_id").agg(F.count("*").alias("n"))
    # ties between parents: lowest node id (the reference's choice is unstable)
    best = hrs.groupBy("page_id").agg(
        F.min_by("parent_id", F.struct((-F.col("n")).alias("a"), F.col("parent_id").alias("b")))
        .alias("parent_id"))
    kids = t.filter(~F.col("name").isin(*HR_SKIP)).select("page_id", "parent_id", "node_id")
    d = kids.join(best, ["page_id", "parent_id"])
    d = d.withColumn("n", F.count("*").over(Window.partitionBy("page_id"))).filter(F.col("n") >= 2)
    return d.select("page_id", "node_id")


def probe_repetition(t: DataFrame) -> DataFrame:
    r = t.filter(F.col("name").isin(*REPEAT_TAGS) & F.col("parent_id").isNotNull())
    r = r.select("page_id", "node_id", "dens_f",
                 F.concat_ws(">", F.col("parent_name"), F.col("name")).alias("sig"))
    sig = r.groupBy("page_id", "sig").agg(F.count("*").alias("n"), F.min("node_id").alias("first"))
    # most frequent signature; ties -> the one seen first in document order
    best = sig.groupBy("page_id").agg(
        F.min_by("sig", F.struct((-F.col("n")).alias("a"), F.col("first").alias("b"))).alias("sig"))
    d = r.join(best, ["page_id", "sig"]).filter(F.col("dens_f") > REPEAT_MIN_WORDS)
    d = d.withColumn("n", F.count("*").over(Window.partitionBy("page_id"))).filter(
        F.col("n") >= REPEAT_MIN_BLOCKS)
    return d.select("page_id", "node_id")


def heuristic_blocks(m: DataFrame, probes: list[str] | None = None) -> DataFrame:
    """Waterfall (O43): (page_id, node_id, probe, confidence) of the first
    probe with confidence >= 0.4 and at least one block."""
    # the probes read the same few rows several times, not the pages' texts
    t = materialize(_tags(m).select("page_id", "node_id", "parent_id", "parent_name", "name", "dens_f", "classes", _marks().alias("attrs")))
    fns = {"data_attr": probe_data_attr, "semantic_class": probe_semantic_class,
           "separator": probe_separator, "repetition": probe_repetition}
    parts = []
    for name in probes or list(fns):
        if CONFIDENCE[name] < MIN_CONFIDENCE:
            continue
        parts.append(fns[name](t).withColumn("prio", F.lit(PRIORITY[name]))
                     .withColumn("probe", F.lit(name)).withColumn("conf", F.lit(CONFIDENCE[name])))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    u = u.withColumn("best", F.min("prio").over(Window.partitionBy("page_id")))
    return u.filter(F.col("prio") == F.col("best")).select("page_id", "node_id", "probe", "conf")
