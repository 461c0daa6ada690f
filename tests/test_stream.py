"""The file stream gives the same turns as the batch job, across several
micro-batches, and a re-delivered page is not extracted twice. Pages without
an id are all in the stream's quarantine."""

import os
import uuid

from conftest import pages_df
from turnstile.operators.extract import Options, extract
from turnstile.session import ensure_checkpoint_dir
from turnstile.streaming.stream import latest_turns, run_to_completion

PAGES = [
    (1, "<html><body><div>first block of words</div><hr><div>second block of words</div></body></html>"),
    (2, "<html><body><p>Only one paragraph of several words</p></body></html>"),
]
NO_ID = [(None, "<p>a page</p>"), (None, "<p>another page</p>")]


def test_stream_matches_batch(spark):
    base = os.path.join(ensure_checkpoint_dir(spark), f"t-{uuid.uuid4().hex}")
    src = os.path.join(base, "in")
    df = pages_df(spark, PAGES)
    df.filter("page_id = 1").write.parquet(os.path.join(src, "a"))
    df.filter("page_id = 2").write.parquet(os.path.join(src, "b"))
    df.filter("page_id = 1").write.parquet(os.path.join(src, "c"))   # re-delivered page
    pages_df(spark, NO_ID).write.parquet(os.path.join(src, "d"))
    opts = Options(detector="heuristic")
    out = run_to_completion(spark, os.path.join(src, "*"), os.path.join(base, "out"),
                            os.path.join(base, "ckpt"), opts)
    got = sorted((r.page_id, r.idx, r.content) for r in out.where("revision = 1").collect())
    assert out.count() == len(got)
    again = spark.read.parquet(os.path.join(base, "out_again")).collect()
    assert [(r.page_id, r.revision) for r in again] == [(1, 1)]
    want = sorted((r.page_id, r.idx, r.content) for r in extract(df, opts).turns.collect())
    assert got == want
    aside = spark.read.parquet(os.path.join(base, "out_quarantine")).where("error = 'no page_id'")
    assert sorted(r.html for r in aside.collect()) == sorted(h for _, h in NO_ID)


def test_changed_and_late_pages_over_restarts(spark):
    base = os.path.join(ensure_checkpoint_dir(spark), f"t-{uuid.uuid4().hex}")
    src, opts = os.path.join(base, "in"), Options(detector="heuristic")
    first, changed = "<body><p>the first form of a page</p></body>", "<body><p>a changed form of it</p></body>"

    def deliver(name, rows):
        pages_df(spark, rows).write.parquet(os.path.join(src, name))
        return run_to_completion(spark, os.path.join(src, "*"), os.path.join(base, "out"), os.path.join(base, "ckpt"), opts)
    deliver("a", [(1, first), (2, first)])
    # each run is a restart: what was seen is known from the state alone
    deliver("b", [(1, first), (1, changed), (2, first)])
    out = deliver("c", [(1, changed), (1, first), (3, changed), (3, first)])
    got = sorted((r.page_id, r.revision, "changed" in r.content) for r in out.collect())
    assert got[:3] == [(1, 1, False), (1, 2, True), (2, 1, False)] and [g[:2] for g in got[3:]] == [(3, 1), (3, 2)]
    again = spark.read.parquet(os.path.join(base, "out_again"))
    assert sorted((r.page_id, r.revision) for r in again.collect()) == [(1, 1), (1, 1), (1, 2), (2, 1)]
    assert sorted((r.page_id, r.revision) for r in latest_turns(out).collect()) == [(1, 2), (2, 1), (3, 2)]


def test_entries_go_after_their_time(spark):
    base = os.path.join(ensure_checkpoint_dir(spark), f"t-{uuid.uuid4().hex}")
    src, opts = os.path.join(base, "in"), Options(detector="heuristic")
    for name in ("a", "b"):
        pages_df(spark, [(1, "<body><p>one page of words</p></body>")]).write.parquet(os.path.join(src, name))
        out = run_to_completion(spark, os.path.join(src, "*"), os.path.join(base, "out"), os.path.join(base, "ckpt"), opts, keep_ms=1)
    assert [r.revision for r in out.collect()] == [1, 1]  # the entry had gone: seen as new
