"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnstile.session import ensure_checkpoint_dir
from turnstile.sources.tables import read_table

__all__ = ["LOWER", "WORDS", "boxed", "checkpoint", "held_out", "labelled_sample", "map_batches", "read_table",
           "text_bytes", "unboxed"]

#: Byte tables for ``bytes.translate``. UTF-8 bytes from 0x80 up belong to
#: characters outside ASCII, so both rules can work on bytes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower-cases A-Z and turns all that is not 0-9, a-z or outside ASCII into
#: a space: ``translate(WORDS).split()`` gives the words
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in LOWER)

#: Rows that a Python step holds as objects at a time.
SLICE_ROWS = 500


def checkpoint(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and read from there after."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_bytes(name: str = "text") -> Column:
    """A text column as UTF-8 bytes, null as empty: Arrow then hands bytes
    to Python without decoding them."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def boxed(docs: DataFrame, *beside: Column) -> DataFrame:
    """All columns of ``docs`` as one struct ``row``, beside others: the names
    of a table's own columns then can't clash with those of an operator."""
    return docs.select(*beside, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unboxed(df: DataFrame, columns: list[str], **made: Column) -> DataFrame:
    """``columns`` out of ``row``, with ``made`` put in their place or behind."""
    # two steps: a new column's name must not hide the columns that others are made of
    made_as = {c: f"made {k}" for k, c in enumerate(made)}
    ready = df.select(df["row"], *[x.alias(made_as[c]) for c, x in made.items()])
    return ready.select(*[(ready[made_as[c]] if c in made else ready["row"].getField(c)).alias(c) for c in columns],
                        *[ready[n].alias(c) for c, n in made_as.items() if c not in columns])


def held_out(doc_id: str = "doc_id") -> Column:
    """The test fold: crc32 of the id as text, mod 4, is 2 (null id: false)."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(4)) == 2, F.lit(False))


def map_batches(df: DataFrame, schema: str,
                start: Callable[[], Callable[[list, pa.RecordBatch], dict]],
                column: str = "text") -> DataFrame:
    """``start()`` runs once in each task and gives a function that gets a
    slice's ``column`` as Python values and the slice itself, and returns
    the output columns by name. Slices bound what Python holds at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                out = work(part.column(column).to_pylist(), part)
                yield pa.RecordBatch.from_arrays(
                    [x.cast(f.type) if isinstance(x := out[f.name], pa.Array) and x.type != f.type
                     else x if isinstance(x, pa.Array) else pa.array(x, f.type) for f in arrow],
                    schema=arrow)

    return df.mapInArrow(run, schema)


def labelled_sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str,
                    rows: int, each: bool = False) -> DataFrame:
    """At most ``rows`` labelled documents outside the test fold, taken by
    the hash of their id; with ``each``, up to half of them of either class.
    Repeated label rows of an id count once (the larger label); null labels
    and null ids are left out. The ids are bounded by ``rows``, so they are
    broadcast and no text is shuffled. Columns: doc_id, label, then those
    of ``docs``."""
    ids = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
           .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
           .withColumn("_h", F.xxhash64("doc_id")))
    if each:
        some = [ids.where(F.col("label") == k).orderBy("_h", "doc_id").limit(rows // 2) for k in (0, 1)]
        ids = some[0].unionByName(some[1])
    else:
        ids = ids.orderBy("_h", "doc_id").limit(rows)
    return docs.join(F.broadcast(ids.select("doc_id", "label")), "doc_id")
