"""What the page jobs read, sort and hand to Python doesn't outgrow their input."""

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from conftest import pages_df
from turnstile.operators import markdown as M, shred as S
from turnstile.operators.dom import subtree_sums
from turnstile.operators.extract import Options, extract, prepare
from turnstile.operators.markdown import block_members
from turnstile.session import materialize
from turnstile.streaming.stream import SeenPages

PAGE = ("<html><body><main>" + "".join(f'<div data-testid="turn-{i}"><p>words of turn {i}</p><blockquote><a href="/u"> link </a>'
                                       "</blockquote></div>" for i in range(4)) + "</main></body></html>")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_block_members_are_runs_of_ids(spark):
    m, *_ = prepare(pages_df(spark, [(1, PAGE)]), Options())
    blocks = m.filter("name IN ('main', 'blockquote')").select("page_id", "node_id", F.col("node_id").alias("block_idx"), F.lit(False).alias("nr"))
    mem = block_members(m, blocks)
    assert "Window" not in plan(mem)  # two windows over all nodes before
    ids = {r.node_id: r.end for r in m.collect()}
    got = sorted((r.block_idx, r.node_id) for r in mem.collect())
    assert got == sorted((r.block_idx, i) for r in blocks.collect() for i in range(r.node_id, ids[r.node_id] + 1))


def test_only_pieces_within_links_and_quotes_are_put_through_windows(spark, monkeypatch):
    taken = []
    put = M._put_together

    def spy(x, within, keys, cells):
        taken.append((x.count(), within.count()))
        return put(x, within, keys, cells)
    monkeypatch.setattr(M, "_put_together", spy)
    turns = extract(pages_df(spark, [(1, PAGE)]), Options(detector="heuristic")).turns.orderBy("idx").collect()
    assert [r.content.strip() for r in turns] == [f"words of turn {i}\n\n> [link](/u)" for i in range(4)]
    (every, within), = taken
    assert within == 4 * 5 and every > within  # two markers a link and a quote, the link's text


def test_leaves_look_up_no_sums(spark):
    nodes, _, _ = S.shred(pages_df(spark, [(1, PAGE), (2, "<p>a<b>c d</b></p>")]))
    rows = {(r.page_id, r.node_id): r for r in nodes.collect()}
    sums = subtree_sums(nodes, {"w": F.col("words")}, carry=("name",))
    assert "(end#" in plan(sums) and " > node_id#" in plan(sums)
    for r in sums.collect():
        end = rows[r.page_id, r.node_id].end
        assert r.sum_w == sum(rows[r.page_id, i].words for i in range(r.node_id, end + 1))
        assert r.name == rows[r.page_id, r.node_id].name


def test_pages_are_read_twice(spark):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b
    pages = pages_df(spark, [(i, f"<p>{i}</p>") for i in range(10)]).mapInArrow(count, "page_id long, url string, html string")
    nodes, *_ = S.shred(pages)
    assert nodes.count() == 30
    assert reads.value == 20  # 30 before: repeats and sizes are one pass


def test_pages_reach_python_a_few_at_a_time(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]}, schema=pa.schema([("n", pa.int64())]))
    out = materialize(spark.range(0, 3000, 1, 1).mapInArrow(sizes, "n long"), records=S.BATCH_PAGES).collect()
    assert sum(r.n for r in out) == 3000 and max(r.n for r in out) <= 500  # 3,000 before


def test_a_page_whose_rows_fail_leaves_the_others(spark, monkeypatch):
    columns = S._page_columns
    monkeypatch.setattr(S, "_page_columns", lambda pid, html: ({"page_id": [pid], "text": [None]}, None) if pid == 2 else columns(pid, html))
    batch = pa.RecordBatch.from_pydict({"page_id": [1, 2, 3], "html": ["<p>a</p>"] * 3}, schema=pa.schema([("page_id", pa.int64()), ("html", pa.string())]))
    rows = [r for b in S._shred_batches(None)([batch]) for r in b.to_pylist()]
    assert [r["page_id"] for r in rows if r["kind"] == "error"] == [2]
    assert sorted({r["page_id"] for r in rows if r["kind"] != "error"}) == [1, 3]


class FakeMap:
    def __init__(self):
        self.entries, self.calls = {}, 0

    def getValue(self, key):
        self.calls += 1
        return self.entries.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.entries[key] = value


class FakeHandle:
    def getMapState(self, *args):
        return FakeMap()


def test_many_pages_share_a_state_call():
    step = SeenPages()
    step.init(FakeHandle())
    rows = pd.DataFrame({"page_id": [1, 2, 1, 1], "url": "", "html": list("abca"), "page": ["1", "2", "1", "1"], "page_hash": [7, 8, 9, 7]})
    out, = step.handleInputRows((0,), iter([rows]), None)  # one group held one page before
    assert out["revision"].tolist() == [1, 1, 2, 1] and out["again"].tolist() == [False, False, False, True]
    assert step.hashes.calls + step.count.calls == 3 * 4 + 1
