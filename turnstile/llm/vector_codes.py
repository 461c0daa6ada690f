"""Vector code compression: product codes with exact integer codebooks.

Components become integers ``floor(4096 * x)``; vectors are cut into equal
parts, and each part position has a codebook that some rounds of assigning
and averaging make.

Each task puts its vectors into chunks of ``CHUNK_ROWS``. Within a chunk the
points of a part position are sorted along a Hilbert curve and cut into flat
blocks of ``BLOCK_ROWS``, which store the points, their box (least and
largest component) and their sum. The chunks are written once; each round
reads them, and nothing but sums by (part, entry, component) is shuffled.

A round compares the codebook with the boxes first: an entry whose least
distance to a box is above the least of all entries' largest distances can be
nearest to no point in it. What remains is the block's shortlist. A block with
one entry on it gives its stored sum; the points of the others are compared
with the entries of the shortlist, in integers.

Integers are 64 bits wide where that is proven to be enough, and Python's own
otherwise, so results are exact for any finite components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from turnstile.llm.common import checkpoint, read_table

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Vectors of a chunk, points of a block.
CHUNK_ROWS = 4096
BLOCK_ROWS = 32
#: A chunk whose components are all this small is stored as 32-bit integers.
NARROW = 2 ** 27
#: Up to this many distinct labels their sums are broadcast.
BROADCAST_LABELS = 100_000
#: Beyond it, each label's rows are dealt to this many keys.
LABEL_SALT = 16

CHUNK = "wide boolean, n int, ids binary, labels array<string>, points binary, order binary, low binary, high binary, sums binary"
_CHUNK = pa.schema([("wide", pa.bool_()), ("n", pa.int32()), ("ids", pa.binary()), ("labels", pa.list_(pa.string())),
                    *[(c, pa.binary()) for c in ("points", "order", "low", "high", "sums")]])


# -- integers

def integers(x: np.ndarray) -> np.ndarray:
    """``floor(4096 * x)``, as 64-bit or as Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x.astype(np.float64) * SCALE)  # a power of two: exact but for overflow
    if not scaled.size or np.abs(scaled).max() < 2.0 ** 62:
        return scaled.astype(np.int64)
    whole = [SCALE * int(v) if abs(v) >= 2.0 ** 53 else int(np.floor(v * SCALE)) for v in x.astype(np.float64).ravel()]
    return np.array(whole, object).reshape(x.shape)


def largest(*arrays: np.ndarray) -> int:
    return max((int(np.abs(a).max()) for a in arrays if a.size), default=0)


def fitting(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as they are if squared distances between their rows surely
    fit 64 bits, else as Python integers."""
    width = max(1, arrays[0].shape[-1])
    if largest(*arrays) < 2 ** 30 and width * (4 * largest(*arrays)) ** 2 < 2 ** 62:
        return [a.astype(np.int64, copy=False) for a in arrays]
    return [a.astype(object) for a in arrays]


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the entry with the least squared distance (the first of
    equals), and that distance."""
    points, entries = fitting(points, entries)
    far = np.zeros((len(points), len(entries)), points.dtype)
    for k in range(points.shape[1]):
        step = points[:, k, None] - entries[None, :, k]
        far += step * step
    best = far.argmin(1) if far.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in far], np.int64)
    return best, far[np.arange(len(points)), best]


# -- blocks

def hilbert_order(points: np.ndarray) -> np.ndarray:
    """Rows in the order of a Hilbert curve through their box: the turns of
    the curve are undone axis by axis (Skilling's transform), all rows at a
    time, and the axes' bits are interleaved."""
    rows, axes = points.shape
    if rows < 2 or not axes:
        return np.arange(rows)
    axes = min(axes, 31)
    bits = min(8, 62 // axes)
    low, high = points[:, :axes].min(0), points[:, :axes].max(0)
    x = ((points[:, :axes] - low) * (2 ** bits - 1) // np.maximum(high - low, 1)).astype(np.int64).T.copy()
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(axes):
            swap = (x[0] ^ x[i]) & (q - 1)
            flip = (x[i] & q) != 0
            x[0] ^= np.where(flip, q - 1, swap)
            x[i] ^= np.where(flip, 0, swap)
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn, q = np.zeros(rows, np.int64), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[axes - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros(rows, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << 1 | (x[i] >> b & 1)
    return np.argsort(key, kind="stable")


def bounds(width: int, parts: int) -> list[int]:
    """Where the parts begin, and the end. A length that ``parts`` doesn't
    divide gives its first parts one component more."""
    return [k * (width // parts) + min(k, width % parts) for k in range(parts + 1)]


def chunk_row(ids: list[int], labels: list[str | None], x: np.ndarray, parts: int) -> dict:
    whole = integers(x)
    row = {"n": len(ids), "ids": np.array(ids, np.int64).tobytes(), "labels": labels}
    if whole.dtype == object or largest(whole) >= NARROW:
        return row | {"wide": True, "points": x.astype(np.float64).tobytes(),
                      "order": b"", "low": b"", "high": b"", "sums": b""}
    starts = np.arange(0, len(ids), BLOCK_ROWS)
    at = bounds(whole.shape[1], parts)
    points, order, low, high, sums = [], [], [], [], []
    for a, b in zip(at, at[1:]):
        turn = hilbert_order(whole[:, a:b])
        own = whole[turn, a:b]
        points.append(own.astype(np.int32).tobytes())
        order.append(turn.astype(np.int32).tobytes())
        low.append(np.minimum.reduceat(own, starts).astype(np.int32).tobytes())
        high.append(np.maximum.reduceat(own, starts).astype(np.int32).tobytes())
        sums.append(np.add.reduceat(own, starts).tobytes())
    return row | {"wide": False, "points": b"".join(points), "order": b"".join(order), "low": b"".join(low),
                  "high": b"".join(high), "sums": b"".join(sums)}


class Part:
    """The points of one part position in a chunk, in blocks; a wide chunk's
    have no blocks and stay in the rows' order."""

    def __init__(self, points: np.ndarray, order: np.ndarray | None = None, low: np.ndarray | None = None,
                 high: np.ndarray | None = None, sums: np.ndarray | None = None) -> None:
        self.points, self.order, self.low, self.high, self.sums = points, order, low, high, sums

    def shortlists(self, entries: np.ndarray) -> np.ndarray:
        """Blocks x entries: whether the entry may be nearest to some point in
        the block's box. It isn't where its least distance to the box is above
        some entry's largest, nor where the entry nearest to the box's middle
        is nearer in the whole box (the difference of the two distances is
        linear along each axis, so its least is at the box's sides)."""
        low, high, e = fitting(self.low, self.high, entries)
        near, far, middle, least = (np.zeros((len(low), len(e)), e.dtype) for _ in range(4))
        for k in range(e.shape[1]):
            under, over = low[:, k, None] - e[None, :, k], e[None, :, k] - high[:, k, None]
            gap = np.maximum(np.maximum(under, over), 0)
            reach = np.maximum(-under, -over)  # the further side of the box
            near += gap * gap
            far += reach * reach
            middle += (under - over) ** 2
        star = e[middle.argmin(1)]
        for k in range(e.shape[1]):
            sides = [(x[:, k, None] - e[None, :, k]) ** 2 - ((x[:, k] - star[:, k]) ** 2)[:, None] for x in (low, high)]
            least += np.minimum(*sides)
        return (near <= far.min(1)[:, None]) & (least <= 0)

    def _lists(self, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(blocks, entries of their shortlist), blocks of one shortlist together."""
        listed = self.shortlists(entries)
        kinds, of = np.unique(listed, axis=0, return_inverse=True)
        for k, kind in enumerate(kinds):
            yield np.flatnonzero(of.ravel() == k), np.flatnonzero(kind)

    def _rows(self, blocks: np.ndarray) -> np.ndarray:
        rows = (blocks[:, None] * BLOCK_ROWS + np.arange(BLOCK_ROWS)).ravel()
        return rows[rows < len(self.points)]

    def sum_up(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per entry the count and the sum of the points nearest to it."""
        if self.low is None:
            code, _ = nearest(self.points, entries)
            total = np.zeros(entries.shape, object)
            np.add.at(total, code, self.points.astype(object))
            return np.bincount(code, minlength=len(entries)), total
        counts, total = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
        for blocks, listed in self._lists(entries):
            if len(listed) == 1:
                counts[listed[0]] += len(self._rows(blocks))
                total[listed[0]] += self.sums[blocks].sum(0)
                continue
            own = self.points[self._rows(blocks)]
            code = listed[nearest(own, entries[listed])[0]]
            counts += np.bincount(code, minlength=len(entries))
            np.add.at(total, code, own)
        return counts, total

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared distances, in the order of the chunk's rows."""
        if self.low is None:
            return nearest(self.points, entries)
        code = np.zeros(len(self.points), np.int64)
        far = np.zeros(len(self.points), object if fitting(self.points, entries)[0].dtype == object else np.int64)
        for blocks, listed in self._lists(entries):
            rows = self._rows(blocks)
            best, d = nearest(self.points[rows], entries[listed])
            code[self.order[rows]], far[self.order[rows]] = listed[best], d
        return code, far


def parts_of(row: dict, width: int, parts: int) -> list[Part]:
    n, at = row["n"], bounds(width, parts)
    if row["wide"]:
        whole = integers(np.frombuffer(row["points"], np.float64).reshape(n, width))
        return [Part(whole[:, a:b]) for a, b in zip(at, at[1:])]
    blocks = -(-n // BLOCK_ROWS)
    out = []
    for k, (a, b) in enumerate(zip(at, at[1:])):
        def cut(name, kind, rows, per):
            size = np.dtype(kind).itemsize * rows
            lo = a if per else k
            hi = b if per else k + 1
            return np.frombuffer(row[name][lo * size:hi * size], kind).reshape((rows, b - a) if per else (rows,))
        out.append(Part(cut("points", np.int32, n, True).astype(np.int64), cut("order", np.int32, n, False),
                        cut("low", np.int32, blocks, True).astype(np.int64),
                        cut("high", np.int32, blocks, True).astype(np.int64), cut("sums", np.int64, blocks, True)))
    return out


# -- sums that may be wider than 64 bits travel as limbs of 32 bits, the last one signed

def limbs(total: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    at = 0
    while largest(total) >= 2 ** 32:
        yield at, (total & (2 ** 32 - 1)).astype(np.int64)
        total, at = total >> 32, at + 1
    yield at, total.astype(np.int64)


def usable(vectors: DataFrame, id_column: str, vector: str, label: str) -> tuple[DataFrame, int]:
    """id, v, label of the rows that take part, and the vectors' length. Of
    several lengths the one that most rows have counts (the least of equals)."""
    kind = dict(vectors.dtypes)[vector]
    v = F.col(f"`{vector}`") if kind in ("array<float>", "array<double>") else F.col(f"`{vector}`").cast("array<double>")
    own = F.col(f"`{label}`").cast("string") if label in vectors.columns else F.lit(None).cast("string")
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), v.alias("v"), own.alias("label"))
    good = rows.where(F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))
    size = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = size.n if size else 0
    return good.where(F.size("v") == width), width


def chunks(rows: DataFrame, width: int, parts: int = PARTS) -> DataFrame:
    """The rows (id, v, label) in Hilbert-sorted blocks, one row for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, held, count = [], [], [], 0

        def done():
            row = chunk_row(ids, labels, np.concatenate(held), parts)
            return pa.RecordBatch.from_pylist([row], schema=_CHUNK)

        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(lo, CHUNK_ROWS)
                if count + part.num_rows > CHUNK_ROWS:
                    yield done()
                    ids, labels, held, count = [], [], [], 0
                ids += part.column("id").to_pylist()
                labels += part.column("label").to_pylist()
                held.append(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width))
                count += part.num_rows
        if count:
            yield done()

    return rows.where("id IS NOT NULL").mapInArrow(run, CHUNK)


def better(blocks: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """One round: the codebooks with each used entry replaced by the floored mean of its points."""
    parts = len(books)

    def run(batches):
        counts = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros(b.shape, object) for b in books]
        for batch in batches:
            for i in range(batch.num_rows):
                for k, part in enumerate(parts_of(batch.slice(i, 1).to_pylist()[0], width, parts)):
                    n, total = part.sum_up(books[k])
                    counts[k] += n
                    totals[k] += total
        out = {"part": [], "entry": [], "pos": [], "limb": [], "value": []}
        for k in range(parts):
            table = np.hstack([counts[k][:, None].astype(object), totals[k]])
            for limb, values in limbs(table):
                entry, pos = np.nonzero(values)
                for name, column in (("part", np.full(len(entry), k)), ("entry", entry), ("pos", pos),
                                     ("limb", np.full(len(entry), limb)), ("value", values[entry, pos])):
                    out[name] += column.tolist()
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
            [(c, pa.int32()) for c in ("part", "entry", "pos", "limb")] + [("value", pa.int64())]))

    # at most parts x entries x (components + 1) x limbs rows come back
    added = (blocks.mapInArrow(run, "part int, entry int, pos int, limb int, value long")
             .groupBy("part", "entry", "pos", "limb").agg(F.sum("value").alias("value")).collect())
    tables = [np.zeros((len(b), b.shape[1] + 1), object) for b in books]
    for r in added:
        tables[r.part][r.entry, r.pos] += r.value << (32 * r.limb)
    return [np.where(t[:, :1] > 0, t[:, 1:] // np.maximum(t[:, :1], 1), b).astype(object) for t, b in zip(tables, books)]


def compact(books: list[np.ndarray]) -> list[np.ndarray]:
    return [b.astype(np.int64) if largest(b) < 2 ** 62 else b for b in books]


def with_label_errors(spark: SparkSession, coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the sum of error over equal labels (nulls
    together). The sums are broadcast if the labels are few enough by a count;
    otherwise each label's rows are dealt to several keys."""
    sums = checkpoint(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")))
    same = lambda a, b: a["label"].eqNullSafe(b["label"])
    if sums.count() <= BROADCAST_LABELS:
        right = F.broadcast(sums)
        return coded.join(right, same(coded, right), "left").drop(right["label"])
    left = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(LABEL_SALT)))
    right = sums.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LABEL_SALT - 1).cast("long"))))
    return (left.join(right, same(left, right) & (left["salt"] == right["salt"]), "left")
            .drop(right["label"], right["salt"]).drop("salt"))


def compress(spark: SparkSession, vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error, label_error for each row that takes part;
    the codebooks, one array of entries x components for each part position).

    Rows with a null id, with a null vector, with null or non-finite components or
    with another length than most take no part. The codebooks begin with the
    vectors of the ``entries`` smallest ids (all, if fewer; rows that repeat an
    id count each, by their components). Ties in distance go to the lower
    index. An error beyond 64 bits, and a label's sum beyond them, is null.
    An empty table gives no rows and empty codebooks; without the label
    column all labels are null; other columns are ignored."""
    rows, width = usable(vectors, id_column, vector, label)
    first = [r.v for r in rows.where("id IS NOT NULL").orderBy("id", "v").limit(entries).select("v").collect()]
    at = bounds(width, parts)
    start = integers(np.array(first, np.float64).reshape(len(first), width))
    books = compact([start[:, a:b] for a, b in zip(at, at[1:])])
    schema = "vec_id long, label string, code string, error long"
    if not first:
        return spark.createDataFrame([], f"{schema}, label_error long"), books
    blocks = checkpoint(chunks(rows, width, parts))
    for _ in range(rounds):
        books = compact(better(blocks, books, width))
    final, digits = books, 2 * max(1, (max(1, entries - 1).bit_length() + 7) // 8)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                codes, error = [], np.zeros(row["n"], object)
                for part, book in zip(parts_of(row, width, parts), final, strict=True):
                    code, far = part.assign(book)
                    codes.append(code)
                    error = error + far
                yield pa.RecordBatch.from_pydict({
                    "vec_id": pa.array(np.frombuffer(row["ids"], np.int64)), "label": pa.array(row["labels"], pa.string()),
                    "code": ["".join(f"{c:0{digits}x}" for c in cs) for cs in np.array(codes).T.tolist()],
                    "error": pa.array([int(e) if e < 2 ** 63 else None for e in error], pa.int64())})

    coded = checkpoint(blocks.mapInArrow(run, schema))
    return with_label_errors(spark, coded), books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for e in b.tolist() for x in e).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(spark, read_table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _op11_sql() -> str:
    """Every distance in every round, by definition."""
    far = ("list_transform(es, lambda e: list_sum(list_transform(range(1, len(v) + 1), "
           "lambda i: (v[i] - e[i]) * (v[i] - e[i]))))")
    steps = [f"""WITH k AS MATERIALIZED (SELECT vec_id, label, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, part, w[part * len(w) // {PARTS} + 1:(part + 1) * len(w) // {PARTS}] AS v
  FROM k, (SELECT unnest(range({PARTS})) AS part)),
c0 AS MATERIALIZED (SELECT part, list(v ORDER BY vec_id, v) AS es FROM p
  WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {ENTRIES}) GROUP BY part)"""]
    for n in range(ROUNDS):
        steps.append(f"""a{n} AS MATERIALIZED (SELECT part, v, list_position(ds, list_min(ds)) AS code FROM (SELECT p.part, v, {far} AS ds FROM p JOIN c{n} USING (part))),
m{n} AS MATERIALIZED (SELECT part, code, list(x ORDER BY i) AS e FROM (
  SELECT part, code, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x
  FROM (SELECT part, code, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY part, code, i) GROUP BY part, code),
c{n + 1} AS MATERIALIZED (SELECT o.part, list(coalesce(m{n}.e, o.e) ORDER BY o.code) AS es
  FROM (SELECT part, unnest(es) AS e, generate_subscripts(es, 1) AS code FROM c{n}) o
  LEFT JOIN m{n} ON m{n}.part = o.part AND m{n}.code = o.code GROUP BY o.part)""")
    steps.append(f"""f AS (SELECT vec_id, label, part, ds, list_min(ds) AS d FROM (SELECT vec_id, label, p.part, {far} AS ds FROM p JOIN c{ROUNDS} USING (part))),
g AS (SELECT vec_id, label, string_agg(lpad(lower(to_hex(list_position(ds, d) - 1)), 2, '0'), '' ORDER BY part) AS code,
  CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY vec_id, label),
s AS (SELECT sha256(string_agg(array_to_string(flatten(es), ','), ',' ORDER BY part)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM g, s""")
    return ",\n".join(steps)


OP11_SQL = _op11_sql()
