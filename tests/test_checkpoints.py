"""Checkpoints keep a page's rows together, and what a shred task holds is bounded."""

import pyarrow as pa
from pyspark.sql import Window, functions as F

from conftest import pages_df
from turnstile.operators import shred as S
from turnstile.session import FIXED_PLAN, materialize


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_checkpoint_keeps_partitioning_and_broadcasts_nothing(spark):
    before = {k: spark.conf.get(k) for k in FIXED_PLAN}
    rows = materialize(spark.range(1000).select((F.col("id") % 50).alias("page_id"), F.col("id").alias("node_id"))
                       .repartition(3, "page_id").sortWithinPartitions("page_id", "node_id"))
    w = Window.partitionBy("page_id").orderBy("node_id")
    marks = rows.filter("node_id < 500").withColumn("n", F.row_number().over(w))
    joined = materialize(rows.join(marks, ["page_id", "node_id"], "left"))
    after = joined.withColumn("k", F.row_number().over(w))
    assert "Exchange" not in plan(after) and "Sort " not in plan(after)
    assert joined.rdd.getNumPartitions() == 3  # a broadcast or a shuffle would not have kept them
    assert after.filter("n IS NOT NULL").count() == 500
    assert before == {k: spark.conf.get(k) for k in FIXED_PLAN}


def test_partitions_grow_with_the_html(spark, monkeypatch):
    monkeypatch.setattr(S, "PART_CHARS", 1000)
    pages = pages_df(spark, [(i, "<p>" + "x" * 190 + "</p>") for i in range(100)])
    nodes, _, _ = S.shred(pages)
    assert nodes.rdd.getNumPartitions() == 20
    assert nodes.count() == 300 and "Exchange" not in plan(nodes.groupBy("page_id").count())


def test_shred_batches_are_small():
    html = "<b>x</b>" * 2000
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(20)), "html": [html] * 20},
                                       schema=pa.schema([("page_id", pa.int64()), ("html", pa.string())]))
    out = list(S._shred_batches(None)([batch]))
    assert sum(b.num_rows for b in out) == 20 * 4001
    assert max(b.num_rows for b in out) <= 25_000  # 65,536 and more before
