"""MinHash near-duplicates by a multi-index Hamming join.

A set of word shingles has a signature of ``4 m`` symbols, each the lowest
``SYMBOL_BITS`` bits of a minimum hash. Two sets of similarity ``J`` differ
in a symbol with probability ``1 - J``, so the distance of their signatures
is binomial; ``m`` is the least number for which a pair at the threshold
differs in ``2 m`` symbols or more with probability under ``MISS``. All
pairs at a distance of at most ``2 m - 1`` are found: of ``m`` chunks of four
symbols one must then have one error or none (pigeonhole), and for each chunk
the four ways to leave one symbol out are enumerated as keys, so such a pair
shares a key. Every pair that is linked is confirmed on the full sets.

Sets that are equal are one class from the start, so a group of copies is one
node however large it is. Keys with the same members count once. The full sets
of a key's members meet in one task (many keys in a group, a large key in
blocks of bounded size), where an inverted index of their shingles gives all
intersections of a member at once. A member is compared only if it isn't in
the component that most of the key's members are in already, and only links
between components leave the task: never all pairs of a group. A key of more
than one block is done block by block first; what its blocks leave
unconnected is then done for each two blocks.

Components are found by passing minima along the links; links and components
stay in Spark.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from turnstile.llm.common import LOWER, boxed, checkpoint, map_batches, read_table, text_bytes, unboxed

SHINGLE_WORDS = 5
THRESHOLD_PERCENT = 80
MISS = 1e-7
SYMBOL_BITS = 16
#: Most members and shingles (of all members) of a key that one block takes.
BLOCK_NODES = 2048
BLOCK_SHINGLES = 1_000_000
#: Shingles that a group of blocks takes about.
GROUP_SHINGLES = 2_000_000
#: Stands for a null id where a row is looked up.
NO_ID = 2 ** 63 - 1


def chunks_for(threshold_percent: int, miss: float = MISS) -> int:
    """Least number of chunks for which a pair at the threshold is missed with probability under ``miss``."""
    p = 1 - threshold_percent / 100
    for m in range(1, 200):
        tail = sum(math.comb(4 * m, k) * p ** k * (1 - p) ** (4 * m - k) for k in range(2 * m, 4 * m + 1))
        if tail < miss:
            return m
    raise ValueError("the threshold is too low for signatures of this kind")


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    """Distinct 64-bit hashes of the ``n``-word shingles; with fewer words one of the whole sequence."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(h))
    with np.errstate(over="ignore"):
        mixed = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            mixed = (mixed ^ h[k:len(h) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def multipliers(symbols: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return (rng.integers(0, 2 ** 63, symbols, np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 2 ** 63, symbols, np.uint64))


def signature(hashes: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Lowest bits of the minimum of each symbol's hash over the set."""
    low = np.full(len(mul), np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 4096):  # bounded memory for very long texts
            x = hashes[at:at + 4096, None] * mul + add
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            low = np.minimum(low, x.min(0))
    return ((low ^ (low >> np.uint64(31))) & np.uint64((1 << SYMBOL_BITS) - 1)).astype(np.int32)


def sketches(docs: DataFrame, shingle_words: int, chunks: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, class (hash of the whole set), signature.
    Empty sets have no class and no signature."""
    mul, add = multipliers(4 * chunks)

    def start():
        def work(texts, part):
            n, kind, sig = [], [], []
            for t in texts:
                h = shingle_hashes(t, shingle_words)
                n.append(len(h))
                kind.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                sig.append(signature(h, mul, add) if len(h) else None)
            return {"doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"), "n_shingles": n,
                    "class": kind, "signature": sig}

        return work

    return map_batches(_columns(docs).withColumn("text_hash", F.xxhash64("text")),
                       "doc_id long, text_hash long, n_shingles long, class binary, signature array<int>", start)


def sets_of(docs: DataFrame, shingle_words: int) -> DataFrame:
    """class, hashes (the full set) of each document."""
    def start():
        def work(texts, part):
            sets = [shingle_hashes(t, shingle_words) for t in texts]
            offsets = pa.array(np.concatenate([[0], np.cumsum(list(map(len, sets)))]).astype(np.int32))
            flat = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))
            return {"class": [xxhash.xxh3_128_digest(h.tobytes()) for h in sets],
                    "hashes": pa.ListArray.from_arrays(offsets, flat)}

        return work

    return map_batches(docs.select("text"), "class binary, hashes array<long>", start)


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))


def keys_of(nodes: DataFrame, chunks: int) -> DataFrame:
    """node, key: for each chunk its four symbols with one left out in turn."""
    keys = F.array(*[
        F.xxhash64(F.lit(4 * c + skip), *[F.get("signature", F.lit(4 * c + k)) for k in range(4) if k != skip])
        for c in range(chunks) for skip in range(4)])
    return nodes.select("node", F.explode(keys).alias("key"))


def shared_keys(nodes: DataFrame, chunks: int) -> DataFrame:
    """(key, node) for keys with two nodes or more; of keys with the same
    nodes one stays. Keys are dealt out once; both the sums and the rows that
    they choose are taken from there."""
    keys = keys_of(nodes, chunks)
    keys = keys.repartition("key")
    # two sums of hashes stand for the set of members
    common = keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("s"),
        F.sum(F.xxhash64(F.lit(1), "node").cast("decimal(20,0)")).alias("t")).where("n > 1")
    shared = checkpoint(keys.join(common, "key"))
    one = shared.groupBy("n", "s", "t").agg(F.min("key").alias("key")).select("key")
    return shared.select("key", "node").join(one, "key")


def find(root: list[int], i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def links_of_key(own: np.ndarray, known: list, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between components among the rows ``own`` of one key: ``known``
    has each row's component so far, ``sets`` each row's shingles."""
    m = len(own)
    names = {k: i for i, k in reversed(list(enumerate(known[r] for r in own)))}
    root = [names[known[r]] for r in own]
    if len(set(root)) == 1:
        return []
    n = np.array([len(sets[r]) for r in own])
    flat = np.concatenate([sets[r] for r in own])
    owner = np.repeat(np.arange(m), n)
    order = np.argsort(flat, kind="stable")
    new = np.concatenate([[True], flat[order][1:] != flat[order][:-1]])
    starts = np.flatnonzero(new)
    code = np.empty(len(flat), np.int64)
    code[order] = np.cumsum(new) - 1
    owners, lengths = owner[order], np.diff(np.append(starts, len(flat)))
    first = np.concatenate([[0], np.cumsum(n)])
    most = np.bincount(root, minlength=m).argmax()
    out = []
    for i in range(m):
        if root[i] == most and known[own[i]] == known[own[most]]:
            continue  # both ends of a pair in the largest component
        c = code[first[i]:first[i + 1]]
        size = lengths[c]
        at = np.repeat(starts[c] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        both = np.bincount(owners[at], minlength=m)
        for j in np.flatnonzero(100 * both >= percent * (n[i] + n - both)):
            x, y = find(root, i), find(root, int(j))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((int(own[i]), int(own[j])))
    return out


def links_within(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between components of the members of each block.
    ``members``: key, block, node, n_shingles, root."""
    total = members.agg(F.sum("n_shingles")).first()[0] or 0
    groups = max(1, -(-total // GROUP_SHINGLES))

    def work(table: pa.Table) -> pa.Table:
        keys = np.stack([table[c].to_numpy() for c in ("key", "block")])
        order = np.lexsort(keys)
        cuts = np.flatnonzero((keys[:, order][:, 1:] != keys[:, order][:, :-1]).any(0)) + 1
        hashes = table["hashes"].combine_chunks()
        flat, at = hashes.flatten().to_numpy(), hashes.offsets.to_numpy() - hashes.offsets[0].as_py()
        own_sets = [flat[a:b] for a, b in zip(at, at[1:])]
        known = table["root"].to_pylist()
        found = [x for own in np.split(order, cuts) for x in links_of_key(own, known, own_sets, percent)]
        a, b = (pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))
        return pa.table({"a": table["node"].take(a), "b": table["node"].take(b)})

    rows = members.join(sets, "node").select(
        F.pmod(F.xxhash64("key", "block"), F.lit(groups)).alias("grp"), "key", "block", "node", "root", "hashes")
    return rows.groupBy("grp").applyInArrow(work, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node that is reachable) of all nodes in ``links``
    (a, b). Every round each node takes the least root among its neighbours,
    then the root of that root; roots only fall, so the rounds end, and each
    halves the way to the least node."""
    edges = checkpoint(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                       .distinct())
    state = checkpoint(edges.groupBy("a").agg(F.min("b").alias("low"))
                       .select(F.col("a").alias("node"), F.least("a", "low").alias("root")))
    while True:
        around = (edges.join(state.toDF("b", "root"), "b").groupBy("a").agg(F.min("root").alias("low"))
                  .withColumnRenamed("a", "node"))
        # a root hooks on to the least root that any of its nodes sees
        seen = state.join(around, "node").select("node", "root", F.least("root", "low").alias("low"))
        hooked = seen.groupBy("root").agg(F.min("low").alias("to"))
        step = checkpoint(seen.join(hooked, "root").select(
            "node", "root", F.least("low", "to").alias("next")))
        jumped = (step.alias("s").join(step.select(F.col("node").alias("n2"), F.col("next").alias("next2")).alias("t"),
                                       F.col("next") == F.col("n2"), "left")
                  .select("node", "root", F.least("next", F.coalesce("next2", "next")).alias("next")))
        jumped = checkpoint(jumped)
        if not jumped.where("next < root").limit(1).count():
            return state
        state = jumped.select("node", F.col("next").alias("root"))


def all_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links that the components need: (a, b). See the module's text."""
    size = members.groupBy("key").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = checkpoint(members.join(size, "key").withColumn(
        "block", F.pmod(F.xxhash64(F.lit(9), "node"), F.col("blocks")).cast("long")))
    links = checkpoint(links_within(placed.withColumn("root", F.col("node")), sets, percent))
    large = placed.where("blocks > 1")
    if not large.limit(1).count():
        return links
    # keys of several blocks whose members aren't one component yet: each two blocks
    root = components(links)
    large = large.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    left = large.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    two = (large.join(left, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
           .where("other <> block")
           .withColumn("block", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")))
    more = links_within(checkpoint(two.select("key", "block", "node", "n_shingles", "root")), sets, percent)
    return checkpoint(links.unionByName(more))


def near_dup(spark: SparkSession, docs: DataFrame, shingle_words: int = SHINGLE_WORDS,
             threshold_percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id that
    is reachable over links), text_hash (xxhash64 of the text's bytes), kept
    (doc_id = component_id).

    Linked are documents with ``100 * common shingles >= threshold_percent *
    shingles of both``. Null, empty and blank texts have no shingle and are
    linked with nothing, not with each other either. Each row is a document;
    rows that repeat a doc_id may be linked or not, and all that have the
    component's smallest id are kept. A null doc_id is larger than any other
    and is kept only if its component has no id. Other columns are ignored."""
    chunks = chunks_for(threshold_percent)
    rows = checkpoint(sketches(docs, shingle_words, chunks))
    # rows of one class have one signature, whichever is taken; one row's text stands for the class
    nodes = checkpoint(rows.where("class IS NOT NULL").groupBy("class").agg(
        F.min("doc_id").alias("low"), F.any_value("n_shingles").alias("n_shingles"),
        F.any_value("signature").alias("signature"),
        F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text_hash")).alias("text_of"))
        .withColumn("node", F.monotonically_increasing_id()))  # fixed from here on, as it is read from the checkpoint
    members = checkpoint(shared_keys(nodes, chunks))
    few = nodes.join(members.select("node").distinct(), "node", "left_semi")
    chosen = few.select(F.col("text_of.id").alias("_id"), F.col("text_of.text_hash").alias("_hash")).distinct()
    own = _columns(docs)
    texts = own.join(chosen, (F.coalesce(own["doc_id"], F.lit(NO_ID)) == F.col("_id"))
                     & (F.xxhash64(own["text"]) == F.col("_hash")), "left_semi")
    sets = checkpoint(sets_of(texts, shingle_words).dropDuplicates(["class"])
                      .join(few.select("class", "node"), "class").select("node", "hashes"))
    members = members.join(nodes.select("node", "n_shingles"), "node")
    links = all_links(members, sets, threshold_percent)
    root = components(links)
    smallest = (nodes.join(root, "node").groupBy("root").agg(F.min("low").alias("component_id")))
    of_class = nodes.join(root, "node", "left").join(smallest, "root", "left").select(
        "class", F.coalesce("component_id", "low").alias("component_id"))
    with_text = rows.where("class IS NOT NULL").join(of_class, "class")
    without = rows.where("class IS NULL").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id", "text_hash"]
    out = with_text.select(*columns).unionByName(without.select(*columns))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (near_dup(spark, read_table(spark, sf_dir, "documents"), shingle_words=3, threshold_percent=85)
            .select("doc_id", "n_shingles", "component_id", "kept"))


def without_copies(spark: SparkSession, docs: DataFrame, shingle_words: int = SHINGLE_WORDS,
                   threshold_percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id;
    of rows that repeat both id and text one stays. All columns pass through."""
    found = checkpoint(near_dup(spark, docs, shingle_words, threshold_percent))
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.lit(1).alias("_n"))
    again = (found.where("kept").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
             .agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    own = boxed(docs, F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_bytes()).alias("hash"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    kept = own.join(gone.distinct(), same, "left_anti")
    if again.limit(1).count():
        one = kept.join(again, same, "left_semi").groupBy("id", "hash").agg(F.any_value("row").alias("row"))
        kept = kept.join(again, same, "left_anti").unionByName(one)
    return unboxed(kept, docs.columns)
