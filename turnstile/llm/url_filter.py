"""URL filter: a blocked Bloom filter of listed canonical URLs passes possible
hits to an exact hash join, which removes the false positives. Host and path
rules go before the list. DataFrame functions only.

The filter is a table: one row for each block of eight 64-bit words, with a
bit set in every word for each listed URL of the block. A URL is looked up
in the one block that its hash names. The filter takes ``BITS_PER_KEY`` bits
a key; up to ``BROADCAST_BYTES`` (counted before) it is broadcast, beyond
that it is joined by block like any other table. Only rows that pass the
filter are shuffled by URL for the exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnstile.llm.common import boxed, read_table, unboxed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_KEY = 16
BLOCK_WORDS = 8
BROADCAST_BYTES = 32 << 20

#: (verdict, rule): the contract's rules.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: The query's list has the canonical URLs of hosts with one of these labels.
LISTED_LABELS = ("cheap-pills", "spam-farm")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.``, path without closing slashes; query and
    fragment are left out. Null for an empty host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", "")))


def _hash(key: Column) -> Column:
    return F.xxhash64(F.lit(17), key)


def _blocks(n_keys: int) -> int:
    return max(1, -(-n_keys * BITS_PER_KEY // (64 * BLOCK_WORDS)))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(_hash(key), F.lit(n_blocks))


def _bit(key: Column, word: int) -> Column:
    """The bit of this key in a block's ``word``: six bits of a second hash."""
    bits = F.xxhash64(F.lit(29), key)
    six = F.shiftright(bits, 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), six)


def bloom_filter(keys: DataFrame, n_keys: int) -> DataFrame:
    """``keys``: a column ``key``. One row per block that is in use: block, w0 ... w7."""
    n = _blocks(n_keys)
    return (keys.groupBy(_block(F.col("key"), n).alias("block"))
            .agg(*[F.bit_or(_bit(F.col("key"), k)).alias(f"w{k}") for k in range(BLOCK_WORDS)]))


def possible(rows: DataFrame, key: str, bloom: DataFrame, n_keys: int) -> DataFrame:
    """``rows`` with ``_possible``: false only where ``key`` is surely not listed."""
    n = _blocks(n_keys)
    small = n * (BLOCK_WORDS + 1) * 8 <= BROADCAST_BYTES
    table = bloom.select(F.col("block").alias("_block"), *[F.col(f"w{k}").alias(f"_w{k}") for k in range(BLOCK_WORDS)])
    found = rows.join(F.broadcast(table) if small else table, _block(F.col(key), n) == F.col("_block"), "left")
    every = F.lit(True)
    for k in range(BLOCK_WORDS):
        every = every & (F.col(f"_w{k}").bitwiseAND(_bit(F.col(key), k)) != 0)
    return (found.withColumn("_possible", F.coalesce(every, F.lit(False)))
            .drop("_block", *[f"_w{k}" for k in range(BLOCK_WORDS)]))


def listed(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``rows`` with ``listed``: whether ``key`` is among ``keys`` (a column
    ``key``, distinct, not null). Null keys aren't listed."""
    n_keys = keys.count()
    if n_keys == 0:
        return rows.withColumn("listed", F.lit(False))
    sifted = possible(rows, key, bloom_filter(keys, n_keys), n_keys)
    exact = keys.select(F.col("key").alias("_key"))
    hits = (sifted.where("_possible").join(exact, F.col(key) == F.col("_key"), "left")
            .withColumn("listed", F.col("_key").isNotNull()).drop("_key", "_possible"))
    rest = sifted.where("NOT _possible").withColumn("listed", F.lit(False)).drop("_possible")
    return hits.unionByName(rest)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits (struct verdict, rule), or null. A rule
    ``host/path`` fits its host and all subdomains where the url's path
    starts with ``/path``; of equally long ones the longer host wins."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"))):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def url_filter(pages: DataFrame, blocked: DataFrame, rules: list[tuple[str, str]] = RULES,
               url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, listed, verdict.

    ``blocked`` has a column ``url``; its canonical forms are the list. A
    rule's verdict holds; without one, listed urls are blocked and others
    allowed. Null urls and urls without ``://`` have empty host and path, fit
    no rule and aren't listed. Every row is judged for itself, repeated rows
    alike. Columns of ``pages`` that are named like those made here are
    replaced, others pass through. ``rules`` is a short list given as a
    parameter."""
    b_host, b_path = host_of(F.col("url")), path_of(F.col("url"))
    keys = blocked.select(canonical(b_host, b_path).alias("key")).where(F.col("key").isNotNull()).distinct()
    parsed = boxed(pages, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    parsed = (parsed.withColumn("canon", canonical(F.col("host"), F.col("path")))
              .withColumn("rule", rule_for(F.col("host"), F.col("path"), rules)))
    return unboxed(
        listed(parsed, "canon", keys), pages.columns, host=F.col("host"), path=F.col("path"), rule=F.col("rule.rule"),
        listed=F.col("listed"),
        verdict=F.coalesce(F.col("rule.verdict"), F.when(F.col("listed"), "block").otherwise("allow")))


def query_list(pages: DataFrame) -> DataFrame:
    """The list that the query takes: urls of ``pages`` on listed hosts."""
    labels = F.split(host_of(F.col("url")), r"\.")
    return pages.where(F.arrays_overlap(labels, F.array(*map(F.lit, LISTED_LABELS)))).select("url")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, query_list(pages)).select("page_id", "host", "path", "rule", "verdict", "listed")


OP2_SQL = r"""
WITH u AS (SELECT page_id, url,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') END AS canon
      FROM u),
black AS (SELECT DISTINCT canon FROM c
          WHERE canon IS NOT NULL AND list_has_any(string_split(host, '.'), ['cheap-pills', 'spam-farm'])),
rules(verdict, rule, rhost, rpath) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
    ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
r AS (SELECT c.page_id, c.url, arg_max(rules.rule, length(rules.rule)) AS rule, arg_max(rules.verdict, length(rules.rule)) AS verdict
      FROM (SELECT DISTINCT page_id, url, host, path FROM c) c
      JOIN rules ON (c.host = rhost OR ends_with(c.host, '.' || rhost)) AND starts_with(c.path, rpath)
      GROUP BY c.page_id, c.url)
SELECT c.page_id, c.host, c.path, r.rule,
       coalesce(r.verdict, CASE WHEN black.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       black.canon IS NOT NULL AS listed
FROM c LEFT JOIN r ON r.page_id = c.page_id AND r.url = c.url LEFT JOIN black ON black.canon = c.canon
"""
