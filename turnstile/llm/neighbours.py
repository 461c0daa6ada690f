"""Approximate nearest neighbours by largest inner product: a forest of
random-projection trees, searched through one priority queue over all trees,
then exact scores of the candidates.

Vectors get one more component, ``sqrt(max norm^2 - norm^2)`` (a query 0), so
that all have the same length and the largest inner product is the nearest
vector. Equal vectors are one class with its ids, so a vector that a third
of all rows hold is one entry of the index.

The trees are fitted on at most ``SAMPLE_ROWS`` classes, taken by hash. Each
node splits at the median of a direction through two of its sampled vectors.
Every class is put into one leaf of each tree. For a query the queue gives
leaves of all trees by their distance to the query until they hold
``CANDIDATES`` classes or the ``SHARE`` of all, whichever is more (vectors
that are spread alike in all directions, as noise is, need a large share for
a given recall; data with structure need few).

Leaves that lie side by side in a tree form groups of about ``GROUP_ROWS``
classes; a larger leaf is cut into chunks, so no group grows with the data.
A query goes once to each group that has a leaf of its, in blocks of
``QUERY_ROWS`` queries. There all scores are computed and the best kept; they
are then computed once more in one order of summing, in double precision on
the original vectors.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from turnstile.llm.common import checkpoint, read_table

NEAREST = 20
QUERY_STEP = 20
SAMPLE_ROWS = 32768
TREES = 10
LEAF_ROWS = 256
CANDIDATES = 5000
SHARE = 1.0
CHUNK_ROWS = 16384
GROUP_ROWS = 65536
QUERY_ROWS = 16384
#: Scores this near, in lengths of the vectors, may be equal but for rounding.
TIE = 1e-12


class Forest:
    """Complete binary trees: node ``i`` has the children ``2i+1`` and
    ``2i+2``; the last ``2**depth`` nodes are the leaves."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int = TREES, leaf_rows: int = LEAF_ROWS,
                 seed: int = 11) -> None:
        n, d = sample.shape
        # as deep as the whole index asks for, as far as the sample has a few vectors for each leaf
        self.depth = max(0, min(int(np.ceil(np.log2(max(1, rows) / leaf_rows))) if rows > leaf_rows else 0,
                                int(np.log2(max(1, n / 8)))))
        self.trees, inner = trees, 2 ** self.depth - 1
        self.planes = np.zeros((trees, inner, d), np.float32)
        self.cuts = np.zeros((trees, inner), np.float32)
        rng = np.random.default_rng(seed)
        for t in range(trees):
            members = {0: np.arange(n)}
            for node in range(inner):
                own = members.pop(node)
                a, b = rng.choice(own, 2) if len(own) else (0, 0)
                plane = sample[a] - sample[b] if len(own) else rng.normal(size=d)
                length = np.linalg.norm(plane)
                plane = plane / length if length > 1e-9 else rng.normal(size=d) / np.sqrt(d)
                side = sample[own] @ plane
                cut = np.median(side) if len(own) else 0.0
                self.planes[t, node], self.cuts[t, node] = plane, cut
                members[2 * node + 1], members[2 * node + 2] = own[side <= cut], own[side > cut]

    @property
    def leaves(self) -> int:
        return 2 ** self.depth

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf codes (tree * leaves + leaf), one column for each tree."""
        out = np.zeros((len(x), self.trees), np.int32)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", x, self.planes[t, node]) > self.cuts[t, node]
                node = 2 * node + 1 + right
            out[:, t] = t * self.leaves + node - (self.leaves - 1)
        return out

    def search(self, x: np.ndarray, sizes: np.ndarray, candidates: int) -> list[list[int]]:
        """For each query the leaves to look into, nearest first, until they
        hold ``candidates`` rows (a row in several trees counts for each)."""
        inner, first = 2 ** self.depth - 1, 2 ** self.depth - 1
        out = []
        for q in x:
            margins = self.planes @ q - self.cuts if inner else None
            queue = [(0.0, t, 0) for t in range(self.trees)]
            found, held = [], 0
            while queue and held < candidates:
                far, t, node = heapq.heappop(queue)
                while node < inner:
                    m = float(margins[t, node])
                    right = m > 0
                    heapq.heappush(queue, (max(far, abs(m)), t, 2 * node + 2 - right))
                    node = 2 * node + 1 + right
                code = t * self.leaves + node - first
                found.append(code)
                held += int(sizes[code])
            out.append(found)
        return out


def lengthened(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with the component that gives all of them the same length."""
    rest = np.sqrt(np.maximum(0.0, most - np.einsum("ij,ij->i", x, x)))
    return np.hstack([x, rest[:, None]]).astype(np.float32)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of float or double) of the rows that take part: id and vector
    not null, no null or non-finite component, not all zero, and of the
    length that most rows have (the smaller of equals)."""
    kind = dict(vectors.dtypes)["embedding"]
    v = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    ok = (F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
          & F.exists("v", lambda x: x != 0))
    good = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
            .where(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False))))
    size = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("v") == (size.n if size else 0))


def classes_of(rows: DataFrame, nearest: int, is_query: Column) -> DataFrame:
    """One row per distinct vector: a, b (hash), v, ids (its ``nearest + 1``
    smallest: more can't be among a result's rows), asked (whether a query
    has it). The ids are cut before the shuffle as well."""
    hashed = rows.withColumns({"a": F.xxhash64("v"), "b": F.xxhash64(F.lit(5), "v")})
    order = Window.partitionBy("a", "b").orderBy("vec_id")
    least = (hashed.select("a", "b", "vec_id").distinct().withColumn("k", F.row_number().over(order))
             .where(F.col("k") <= nearest + 1).groupBy("a", "b").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    own = hashed.groupBy("a", "b").agg(F.any_value("v").alias("v"), F.max(is_query).alias("asked"))
    return own.join(least, ["a", "b"])


def nearest_classes(spark: SparkSession, classes: DataFrame, nearest: int) -> DataFrame:
    """a, b of each asked class with found: its candidates' (score, id), best
    first, ties to the smaller id, ``nearest + 1`` of them."""
    empty = "a long, b long, found array<struct<score:double,id:long>>"
    head = classes.agg(F.count(F.lit(1)).alias("rows"), F.count_if("asked").alias("asked"), F.max(F.size("v")).alias("dim"),
                       F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("most")).first()
    if not head.asked:
        return spark.createDataFrame([], empty)
    rows, dim, most = head.rows, head.dim, head.most
    blocks = -(-head.asked // QUERY_ROWS)
    sample = np.array([r.v for r in classes.orderBy("a", "b").select("v").limit(SAMPLE_ROWS).collect()])
    forest = spark.sparkContext.broadcast(Forest(lengthened(sample, most), rows, TREES, LEAF_ROWS))

    def put(batches):
        f = forest.value
        for batch in batches:
            codes = f.leaf_of(lengthened(matrix(batch.column("v"), dim), most))
            yield pa.RecordBatch.from_arrays([pa.array(codes.ravel())], names=["leaf"])

    counted = classes.select("v").mapInArrow(put, "leaf int").groupBy("leaf").count().collect()  # bounded by the forest
    sizes = np.zeros(forest.value.trees * forest.value.leaves, np.int64)
    for r in counted:
        sizes[r.leaf] = r["count"]
    parts = np.maximum(1, -(-sizes // CHUNK_ROWS))
    first = np.concatenate([[0], np.cumsum(parts)])  # a number for each chunk of each leaf
    weight = np.repeat(sizes / parts, parts)
    tree = np.repeat(np.arange(len(sizes)) // forest.value.leaves, parts)
    group = np.zeros(len(weight), np.int64)  # chunks side by side in one tree, up to GROUP_ROWS together
    for t in range(forest.value.trees):
        own = np.flatnonzero(tree == t)
        group[own] = (group[own[0] - 1] + 1 if t else 0) + (np.cumsum(weight[own]) - weight[own]) // GROUP_ROWS
    plan = spark.sparkContext.broadcast((sizes, parts, first, group))
    candidates = max(CANDIDATES, int(SHARE * rows))

    def in_batches(columns, names):
        for lo in range(0, len(columns[0]), 4096):
            yield pa.RecordBatch.from_arrays([c.slice(lo, 4096) for c in columns], names=names)

    def put_index(batches):
        f, (_, n, at_first, of) = forest.value, plan.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                code = f.leaf_of(lengthened(matrix(batch.column("v"), dim), most)).astype(np.int64).ravel()
                at = np.repeat(np.arange(batch.num_rows), f.trees)
                chunk = at_first[code] + np.abs(batch.column("a").to_numpy()[at] >> 1) % n[code]
                block = np.repeat(np.arange(blocks), len(at))
                at, chunk = np.tile(at, blocks), np.tile(chunk, blocks)
                taken = pa.array(at)
                yield from in_batches(
                    [pa.array(of[chunk] * blocks + block), pa.array(chunk),
                     batch.column("v").take(taken), batch.column("ids").take(taken)], ["grp", "chunk", "v", "ids"])

    def put_queries(batches):
        f, (size, n, at_first, of) = forest.value, plan.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                x = matrix(batch.column("v"), dim)
                block = np.abs(batch.column("b").to_numpy() >> 1) % blocks
                at, grp, chunks = [], [], []
                for i, leaves in enumerate(f.search(np.hstack([x, np.zeros((len(x), 1))]).astype(np.float32), size, candidates)):
                    chunk = np.sort(np.concatenate([np.arange(at_first[c], at_first[c] + n[c]) for c in leaves]))
                    groups, starts = np.unique(of[chunk], return_index=True)
                    at += [i] * len(groups)
                    grp += (groups * blocks + block[i]).tolist()
                    chunks += np.split(chunk, starts[1:])
                taken = pa.array(np.array(at, np.int64))
                yield from in_batches(
                    [pa.array(grp, pa.int64()), pa.array(chunks, pa.list_(pa.int64())),
                     *[batch.column(c).take(taken) for c in ("a", "b", "v")]], ["grp", "chunks", "a", "b", "v"])

    kind = dict(classes.dtypes)["v"]
    index = classes.select("a", "v", "ids").mapInArrow(put_index, f"grp long, chunk long, v {kind}, ids array<long>")
    asks = classes.where("asked").select("a", "b", "v").mapInArrow(
        put_queries, f"grp long, chunks array<long>, a long, b long, v {kind}")

    def exact(q, v, at_q, at_v):
        return np.concatenate([np.zeros(0), *[
            (q[at_q[lo:lo + 8192]] * v[at_v[lo:lo + 8192]]).sum(1) for lo in range(0, len(at_q), 8192)]])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        keep = nearest + 1
        rows_q, rows_v, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            q, v = matrix(left["v"], dim), matrix(right["v"], dim)
            least = pc.list_element(right["ids"].combine_chunks(), 0).to_numpy(zero_copy_only=False)
            tie = TIE * np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max()
            lists = left["chunks"].combine_chunks()
            q_chunk = lists.flatten().to_numpy()
            q_row = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
            q_order = np.argsort(q_chunk, kind="stable")
            q_chunk, q_row = q_chunk[q_order], q_row[q_order]
            v_chunk = right["chunk"].to_numpy()
            v_row = np.argsort(v_chunk, kind="stable")
            v_chunk = v_chunk[v_row]
            for c in np.unique(v_chunk):
                own = v_row[np.searchsorted(v_chunk, c):np.searchsorted(v_chunk, c, "right")]
                asking = q_row[np.searchsorted(q_chunk, c):np.searchsorted(q_chunk, c, "right")]
                k = min(keep, len(own))
                for lo in range(0, len(asking), 512):
                    some = asking[lo:lo + 512]
                    s = q[some] @ v[own].T
                    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    # of more rows that tie with the k-th those of the smallest ids
                    bound = np.take_along_axis(s, top, 1).min(1) - tie[some]
                    for i in np.flatnonzero((s >= bound[:, None]).sum(1) > k):
                        tied = np.flatnonzero(s[i] >= bound[i])
                        e = exact(q, v, np.full(len(tied), some[i]), own[tied])
                        top[i] = tied[np.lexsort((least[own[tied]], -e))[:k]]
                    rows_q.append(np.repeat(some, k))
                    rows_v.append(own[top].ravel())
                    scores.append(np.take_along_axis(s, top, 1).ravel())
        at_q, at_v, s = map(np.concatenate, (rows_q, rows_v, scores))
        if len(at_q):  # by score, with what ties at the cut; then by exact score and id
            order = np.lexsort((-s, at_q))
            at_q, at_v, s = at_q[order], at_v[order], s[order]
            first, after = np.searchsorted(at_q, at_q), np.searchsorted(at_q, at_q, "right")
            near = s >= s[np.minimum(first + keep, after) - 1] - tie[at_q]
            at_q, at_v = at_q[near], at_v[near]
            s = exact(q, v, at_q, at_v)
            order = np.lexsort((least[at_v], -s, at_q))
            at_q, at_v, s = at_q[order], at_v[order], s[order]
            rank = np.arange(len(at_q)) - np.searchsorted(at_q, at_q)
            at_q, at_v, s = at_q[rank < keep], at_v[rank < keep], s[rank < keep]
        taken = pa.array(at_q)
        return pa.table({"a": left["a"].take(taken), "b": left["b"].take(taken),
                         "score": s, "ids": right["ids"].take(pa.array(at_v))})

    pairs = asks.groupBy("grp").cogroup(index.groupBy("grp")).applyInArrow(
        score, "a long, b long, score double, ids array<long>")
    # a class that several trees found is there several times, with one score
    each = pairs.select("a", "b", "score", F.explode("ids").alias("id")).distinct()
    order = Window.partitionBy("a", "b").orderBy(F.desc("score"), "id")
    ranked = each.withColumn("k", F.row_number().over(order)).where(F.col("k") <= nearest + 1)
    best = F.array_sort(F.collect_list(F.struct("k", "score", "id")))
    return ranked.groupBy("a", "b").agg(F.transform(
        best, lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id"))).alias("found"))


def neighbours(spark: SparkSession, vectors: DataFrame, nearest: int = NEAREST,
               query_step: int = QUERY_STEP) -> DataFrame:
    """For each vec_id divisible by ``query_step`` the ``nearest`` rows with
    the largest inner product among those found: query_id, rank (from 1),
    vec_id, score.

    Rows with a null id, and null, zero, non-finite vectors or vectors of
    another length than most take no part. Rows that repeat id and vector
    count once; where an id has several vectors each is searched and found,
    but never by its own id. Ties go to the smaller vec_id. Other columns are
    ignored."""
    rows = usable(vectors)
    is_query = F.col("vec_id") % query_step == 0
    classes = checkpoint(classes_of(rows, nearest, is_query))
    found = nearest_classes(spark, classes, nearest)
    queries = rows.where(is_query).select("vec_id", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(5), "v").alias("b")).distinct()
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("vec_id")), 1, nearest)
    return (queries.join(found, ["a", "b"]).select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("pos", "x"))
            .select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score")))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, read_table(spark, sf_dir, "embeddings"))
