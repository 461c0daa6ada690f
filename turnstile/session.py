"""Session helpers: building a session for tests/bench and cutting lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "turnstile", cpus: str | int | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Local session used by tests and bench. On a cluster the session is
    supplied by the caller and this function is not used."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TURNSTILE_DRIVER_MEM", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only when it is unset
    (local tests) create a scratch folder of our own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="turnstile-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def co_partition_by_prefix(spark: SparkSession) -> None:
    """Joins on ``(page_id, x)`` may reuse a hash partitioning on ``page_id``
    alone: every DOM table is partitioned that way once, after the shred."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


#: How checkpoints are planned. The result of an adaptive plan has no known
#: partitioning, so every later step would shuffle and sort a page's rows anew;
#: and Spark guesses the size of parsed rows from that of the html, so it would
#: broadcast tables of millions of nodes. ``F.broadcast`` still holds.
FIXED_PLAN = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


def materialize(df: DataFrame, records: int | None = None) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder: cuts lineage
    so a lost executor does not replay the Python shred. The result keeps the
    partitioning and the order of ``df``. ``records``: rows that cross into
    Python at a time."""
    conf = df.sparkSession.conf
    ensure_checkpoint_dir(df.sparkSession)
    plan = FIXED_PLAN | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(records)} if records else {})
    before = {k: conf.get(k) for k in plan}
    try:
        for k, v in plan.items():
            conf.set(k, v)
        return df.checkpoint(eager=True)
    finally:
        for k, v in before.items():
            conf.set(k, v)
