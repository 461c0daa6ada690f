"""Re-aim of "read a page from a pipe" (O02, §2.10): pages arriving as files
in a directory are extracted by a Structured Streaming query.

* source: ``readStream`` parquet files ``(page_id, url, html)``;
* what was seen of a page is keyed state (``transformWithState``): by page_id
  the html hashes, each an entry of its own, and their number; pages are dealt
  into ``GROUPS`` groups, as a call into Python for each page costs far more than its entries. A page with
  html that was not seen gets the next ``revision`` and is extracted; one that
  was seen is written to a table of its own and not extracted again. Pages
  without an id count as delivered again if their html is the same;
* by default an entry stays for good, so a page may come again after any
  delay; with ``keep_ms`` a timer drops entries that old, which bounds the state;
* each micro-batch is checkpointed once, as every further use of it would run
  the stateful step again, and on the same state at the same time;
* each micro-batch runs the same batch extraction in ``foreachBatch`` and
  overwrites its own ``batch_id=N`` folder, so a replayed batch after a
  failure rewrites rather than duplicates (idempotent sink);
* beside the turns (page_id, page_hash, revision, ...) each micro-batch writes
  ``<sink>_quarantine``, ``<sink>_diagnostics`` and ``<sink>_again``;
* ``latest_turns`` gives the turns of each page's last revision;
* ``availableNow`` processes what is there and stops.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnstile.operators.extract import Options, extract
from turnstile.session import materialize

PAGE_SCHEMA = "page_id long, url string, html string"
SEEN_SCHEMA = "page_id long, url string, html string, page_hash long, revision int, again boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups of the state step: pages share a group's call into Python and its entries, which are by page.
GROUPS = 2048


class SeenPages(StatefulProcessor):
    """Per page: its html hashes and their number, one entry each in a group's maps."""

    def __init__(self, keep_ms: int | None = None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hashes = handle.getMapState("hashes", "page string, page_hash long", "revision int", self.keep_ms)
        self.count = handle.getMapState("count", "page string", "n int", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            revision, again = [], []
            for page, h in zip(part["page"], part["page_hash"]):
                seen = self.hashes.getValue((page, int(h)))
                again.append(seen is not None)
                if seen is None:
                    n = (self.count.getValue((page,)) or (0,))[0] + 1
                    self.count.updateValue((page,), (n,))
                    self.hashes.updateValue((page, int(h)), (n,))
                    seen = (n,)
                revision.append(seen[0])
            yield pd.DataFrame({"page_id": part["page_id"].astype("Int64"), "url": part["url"], "html": part["html"],
                                "page_hash": part["page_hash"], "revision": pd.array(revision, "int32"), "again": again})

    def close(self) -> None:
        pass


def seen(src: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """Each delivered page with its hash, its revision and whether it was seen before."""
    own = F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("no id "), F.sha2(F.coalesce("html", F.lit("")), 256)))
    rows = src.select("page_id", "url", "html", F.xxhash64("html").alias("page_hash"), own.alias("page"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("page"), F.lit(GROUPS)))
    return rows.groupBy("part").transformWithStateInPandas(
        SeenPages(keep_ms), SEEN_SCHEMA, "Append", "ProcessingTime" if keep_ms else "None")


def start_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                 opts: Options | None = None, max_files_per_trigger: int | None = None, keep_ms: int | None = None):
    opts = opts or Options()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # keyed state with entries needs it
    if keep_ms:  # timers alone would start batch after batch, so that a run over what is there never ends
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    reader = spark.readStream.schema(PAGE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = seen(reader.parquet(source_dir), keep_ms)

    def run_batch(df: DataFrame, batch_id: int) -> None:
        rows = materialize(df)
        fresh = rows.where("NOT again")
        ex = extract(fresh.select("page_id", "url", "html"), opts)
        of = fresh.where("page_id IS NOT NULL").select(F.col("page_id").alias("_id"), "page_hash", "revision")

        def with_revision(out: DataFrame) -> DataFrame:
            """Version is null for pages that are the only one of their id in the batch."""
            mine = F.expr("o.page_id = f._id AND (o.version IS NULL OR o.version = f.page_hash)")
            return ex.named(out).alias("o").join(of.alias("f"), mine, "left").select("o.*", "f.page_hash", "f.revision").drop("version")

        for out, folder in ((with_revision(ex.turns), sink_dir), (ex.quarantine, f"{sink_dir}_quarantine"),
                            (with_revision(ex.diagnostics), f"{sink_dir}_diagnostics"),
                            (rows.where("again").select("page_id", "url", "page_hash", "revision"), f"{sink_dir}_again")):
            out.write.mode("overwrite").parquet(os.path.join(folder, f"batch_id={batch_id}"))

    return (src.writeStream.foreachBatch(run_batch)
            .option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True).start())


def run_to_completion(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                      opts: Options | None = None, max_files_per_trigger: int | None = None,
                      keep_ms: int | None = None) -> DataFrame:
    q = start_stream(spark, source_dir, sink_dir, checkpoint_dir, opts, max_files_per_trigger, keep_ms)
    q.awaitTermination()
    return spark.read.parquet(sink_dir)


def latest_turns(turns: DataFrame) -> DataFrame:
    """The turns of each page's last revision."""
    last = turns.groupBy("page_id").agg(F.max("revision").alias("revision"))
    return turns.join(last, ["page_id", "revision"], "left_semi")
