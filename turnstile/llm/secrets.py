"""Secret scan with corpus-wide ownership. DataFrame functions only.

Spans of the base kinds (assign, access, hex) and of the candidate kinds
(private key headers, provider tokens, signed web tokens, opaque tokens) are
found in each whole text. The value of each span is hashed, and for each
hash the distinct repositories and owners that hold it are counted over the
corpus. A candidate that many owners hold, or many repositories of few
owners, is a widely copied example; one that stays with few owners and few
repositories looks live, and its span is added. Base spans stay whatever
their class, which is returned beside them with both counts.

A text gives the lengths of its matches and of what lies between them; the
offsets are running sums over these, and windows over a text's spans tell
which candidates overlap a base span.

Only hashes and offsets are shuffled, never text. The counts are summed
before each shuffle: first by (hash, owner, repository), then by (hash,
owner), then by hash, so a value that a third of all rows hold is no hot
group. The join that gives each span its class is a plain equi-join on the
hash, which Spark can split where a hash is hot.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from turnstile.llm.common import checkpoint, read_table

#: kind, pattern, group of the value, least length of that group. The first
#: three are the contract's base kinds, in its order; the others are
#: candidates of the method.
BASE = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    # a maximal run that is long enough is what the base pattern gives after dropping short ones
    ("access", r"(AKIA[A-Z0-9]{12,})", 1, 16),
    ("hex", r"([0-9a-f]{32,})", 1, 32),
]
CANDIDATES = [
    ("private_key", r"(-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----)", 1, 1),
    ("provider", r"\b((?:gh[opsu]|glpat|xox[abprs]|sk|pk|rk)[_-][A-Za-z0-9_-]{16,})", 1, 16),
    ("web_token", r"\b(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 8),
    ("opaque", r"(?<![A-Za-z0-9+/_=-])([A-Za-z0-9+/_=-]{20,})", 1, 20),
]
#: What the value of a kind must hold besides, looked for in the whole value.
NEEDED = {"opaque": ("[0-9]", "[A-Za-z]")}
KINDS = [k for k, *_ in BASE + CANDIDATES]
#: A value held by more owners than this is a widely copied example.
MAX_OWNERS = 3
#: Within those owners, so is one held by more repositories than this.
MAX_REPOSITORIES = 100

PIECE = "array<struct<kind:int,pos:int,gap:int,size:int,value:long,span:boolean>>"


def _pieces(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """The matches of one kind in a text, in order: how many code points lie
    between a match and the one before it, its size, the hash of its value,
    and whether it is a span (its value is long enough and holds what it must)."""
    p = F.lit(pattern)
    value = lambda w: F.regexp_extract(w, pattern, group) if group > 1 else w
    good = lambda v: reduce(and_, (F.rlike(v, F.lit(n)) for n in NEEDED.get(KINDS[kind], ())), F.length(v) >= least)
    found = F.transform(
        F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
                     F.regexp_extract_all(text, p, F.lit(0)).alias("w")),
        lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), m["gap"].alias("gap"), F.length(m["w"]).alias("size"),
                              F.xxhash64(F.lit(3), value(m["w"])).alias("value"), good(value(m["w"])).alias("span")))
    # what is behind the last match has no match of its own
    return F.when(F.regexp_like(text, p), F.filter(found, lambda m: m["size"].isNotNull())).otherwise(F.array().cast(PIECE))


def matches(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """One row per document: row (a number), doc_id, owner, repository, pieces."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.col(f"`{owner}`") if owner in docs.columns else F.lit(None)
    repo = F.col(f"`{repository}`") if repository in docs.columns else F.lit(None)
    pieces = F.flatten(F.array(*[_pieces(F.col("_text"), i, p, g, n) for i, (_, p, g, n) in enumerate(BASE + CANDIDATES)]))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.cast("string").alias("owner"),
                        repo.cast("string").alias("repository"), text.alias("_text"))
            .select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", pieces.alias("pieces")))


def spans(found: DataFrame) -> DataFrame:
    """One row per span: row, owner, repository, start, kind, end, value. A
    candidate span that overlaps a base span is left to the base span.

    Offsets are running sums over a text's pieces. A span overlaps a base
    span if one that begins no later ends behind its start, or the next one
    begins before its end; both are running values over the text's spans, so
    time grows with their number."""
    each = (found.where(F.size("pieces") > 0)
            .select("row", "owner", "repository", F.explode("pieces").alias("m")).select("row", "owner", "repository", "m.*"))
    along = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # every window is within a text: one exchange serves all
    placed = (each.repartition("row").withColumn("end", F.sum(F.col("gap").cast("long") + F.col("size")).over(along))
              .where("span").select("row", "owner", "repository", (F.col("end") - F.col("size")).alias("start"), "kind", "end", "value"))
    upward = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    downward = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = F.col("kind") < len(BASE)
    before, behind = F.max(F.when(base, F.col("end"))).over(upward), F.min(F.when(base, F.col("start"))).over(downward)
    free = ~(F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(behind < F.col("end"), F.lit(False)))
    return placed.withColumn("_free", base | free).where("_free").drop("_free")


def ownership(found: DataFrame) -> DataFrame:
    """Per value: n_owners, n_repositories (distinct; null owners are one owner)."""
    held = found.select("value", F.coalesce("owner", F.lit("")).alias("owner"),
                        F.coalesce("repository", F.lit("")).alias("repository"))
    by_owner = held.distinct().groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"))
    # a repository belongs to one owner; one that several owners name counts for each
    return by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def number_of(kind: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id",
            max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """Per document: doc_id, spans (array of start, kind, end, value hash,
    live, n_owners, n_repositories), sorted by start, then kind.

    Base spans are all there, ``live`` false on those that more than
    ``max_owners`` owners or more than ``max_repositories`` repositories
    hold; candidate spans are there only if live. Null
    and empty texts have no span; texts of any length are searched whole.
    Rows that repeat a doc_id each give a row; a null owner is an owner, a
    null repository a repository; an empty table gives no rows. Other columns
    are ignored."""
    found = checkpoint(matches(docs, owner, repository))
    each = checkpoint(spans(found))
    known = ownership(each)
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    judged = (each.join(known, "value").where(live | (F.col("kind") < len(BASE)))
              .select("row", F.struct("start", "kind", "end", "value", live.alias("live"),
                                      "n_owners", "n_repositories").alias("s")))
    by_row = judged.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    kind = "array<struct<start:long,kind:int,end:long,value:long,live:boolean,n_owners:long,n_repositories:long>>"
    none = F.array().cast(kind)
    with_spans = (found.where(F.size("pieces") > 0).select("row", "doc_id").join(by_row, "row", "left")
                  .select("doc_id", F.coalesce("spans", none).alias("spans")))
    return with_spans.unionByName(found.where(F.size("pieces") == 0).select("doc_id", none.alias("spans")))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(read_table(spark, sf_dir, "documents"))
    count = [number_of(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select(
        "doc_id", *count, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"))
