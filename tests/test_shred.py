"""Tree contract of the shred (pure Python helper, no Spark needed), and what
it sets aside."""

import pytest

from conftest import pages_df
from turnstile.operators import shred as shred_module
from turnstile.operators.shred import _page_columns, given_ids, shred


def rows(html):
    c, _ = _page_columns(7, html)
    return [dict(zip(c, v)) for v in zip(*c.values())]


def by_name(rs, name):
    return [r for r in rs if r["name"] == name]


def test_end_tag_closes_to_nearest_open():
    rs = rows("<div><b>x<p>y</div>z")
    div, b, p = by_name(rs, "div")[0], by_name(rs, "b")[0], by_name(rs, "p")[0]
    z = [r for r in rs if r["text"] == "z"][0]
    assert b["parent_id"] == div["node_id"] and p["parent_id"] == b["node_id"]
    assert div["end"] == max(r["node_id"] for r in rs if r["text"] == "y")
    assert z["parent_id"] == 0 and z["depth"] == 1


def test_unmatched_end_tag_ignored_and_void():
    rs = rows("<p>a</span><br>b</br><img src=x>c</p>")
    p = by_name(rs, "p")[0]
    assert all(r["parent_id"] == p["node_id"] for r in rs if r["node_id"] > p["node_id"])
    assert by_name(rs, "br")[0]["end"] == by_name(rs, "br")[0]["node_id"]


def test_no_implied_p_close_and_nesting_depth():
    rs = rows("<p>a<p>b<p>c")
    ps = by_name(rs, "p")
    assert [r["depth"] for r in ps] == [1, 2, 3]
    assert (ps[2]["parent_id"], ps[2]["gparent_id"]) == (ps[1]["node_id"], ps[0]["node_id"])


def test_whitespace_runs_and_script_text():
    rs = rows('<div>\n   <script>var t="</p>";</script> <pre>  </pre></div>')
    texts = [(r["kind"], r["text"]) for r in rs if r["text"] is not None]
    assert ("text", "\n") in texts and ("text", " ") in texts
    assert ("script", 'var t="</p>";') in texts
    assert ("text", "  ") in texts          # kept verbatim inside pre


def test_attrs_classes_entities():
    rs = rows('<div class="a  b" data-x id=q>&amp; &lt;x&gt;</div>')
    d = by_name(rs, "div")[0]
    assert d["classes"] == ["a", "b"]
    assert dict(d["attrs"]) == {"class": "a  b", "data-x": "", "id": "q"}
    assert [r["text"] for r in rs if r["kind"] == "text"] == ["& <x>"]
    assert [r["words"] for r in rs if r["kind"] == "text"] == [2]


def test_nested_set_intervals_are_consistent():
    rs = rows("<html><body><ul><li>a<li>b</ul><p>c</p></body></html>")
    for r in rs:
        kids = [k for k in rs if k["parent_id"] == r["node_id"]]
        if kids:
            assert r["end"] == max(k["end"] for k in kids)
        assert r["node_id"] <= r["end"]


def test_source_spans():
    h = '<html>\n<body><div class="a">Hi <b>there</b></div><br><p>x</body></html>'
    rs = rows(h)
    span = {r["name"] or r["text"]: h[r["src_start"]:r["src_end"]] for r in rs}
    assert span["div"] == '<div class="a">Hi <b>there</b></div>'
    assert span["b"] == "<b>there</b>" and span["br"] == "<br>" and span["p"] == "<p>x"
    assert span["body"] == '<body><div class="a">Hi <b>there</b></div><br><p>x</body>'
    assert span["there"] == "there"


PAGES = [(1, "<p>one</p>"), (1, "<p>another crawl of it</p>"), (1, "<p>another crawl of it</p>"), (2, "<p>single</p>"), (3, None),
         (3, "<p>one</p>"), (4, "<p>single</p>"), (4, "<p>single</p>"), (None, "<p>one</p>")]


@pytest.mark.parametrize("repeated", ["least_hash", "longest"])
@pytest.mark.parametrize("limit", [shred_module.BROADCAST_IDS, 0])
def test_pages_of_one_page_id_are_all_shredded(spark, repeated, limit, monkeypatch):
    monkeypatch.setattr(shred_module, "BROADCAST_IDS", limit)
    nodes, quarantine, versions = shred(pages_df(spark, PAGES), repeated)
    texts = given_ids(nodes.where("kind = 'text'"), versions).select("page_id", "text", "version").collect()
    assert sorted((r.page_id, r.text) for r in texts) == [
        (1, "another crawl of it"), (1, "one"), (2, "single"), (3, "one"), (4, "single")]
    assert [r.version is None for r in sorted(texts)] == [False, False, True, False, False]
    assert nodes.where("kind = 'document'").count() == 6  # the page of null html, too
    # each given row is either shredded or set aside
    assert sorted(((r.page_id, r.error, r.html) for r in quarantine.collect()), key=str) == sorted([
        (1, "copy of a page", "<p>another crawl of it</p>"), (4, "copy of a page", "<p>single</p>"),
        (None, "no page_id", "<p>one</p>")], key=str)
    keeps = {r.given_id: r.page_hash for r in versions.where("page_id = given_id").collect()}
    assert keeps.keys() == {1, 3, 4}


def test_a_taken_key_is_set_aside(spark):
    from pyspark.sql import functions as F
    rows = [(1, "<p>one</p>"), (1, "<p>two</p>")]
    nodes, _, versions = shred(pages_df(spark, rows))
    key = versions.where("page_id <> given_id").first().page_id
    nodes, quarantine, versions = shred(pages_df(spark, rows + [(key, "<p>three</p>")]))
    assert [(r.page_id, r.error) for r in quarantine.collect()] == [(1, "key taken by another page")]
    got = sorted((r.page_id, r.text) for r in given_ids(nodes.where(F.col("kind") == "text"), versions).collect())
    assert len(got) == 2 and (key, "<p>three</p>"[3:-4]) in got


def test_unknown_rule(spark):
    with pytest.raises(ValueError):
        shred(pages_df(spark, PAGES), "first")


def test_failing_pages_reach_the_quarantine_with_their_html(spark, monkeypatch):
    many = "<i>" * 40
    nodes, quarantine, _ = shred(pages_df(spark, [(1, many), (2, "<p>fine</p>"), (3, many + "x")]), max_nodes=30)
    assert sorted((r.page_id, r.error, r.html) for r in quarantine.collect()) == [
        (1, "more than 30 nodes", many), (3, "more than 30 nodes", many + "x")]
    assert {r.page_id for r in nodes.select("page_id").distinct().collect()} == {2}
    # what fails while a page's batches are built is that page's error, too
    monkeypatch.setattr(shred_module, "_page_columns", lambda *a: ({"page_id": [1], "text": [None], "attrs": [None], "bad": [0]}, None))
    batch, = shred_module._page_batches(1, "<p>", None)
    assert batch.column("kind").to_pylist() == ["error"] and batch.column("text").to_pylist() == ["<p>"]


def test_a_page_comes_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(shred_module, "BATCH_ROWS", 10)
    monkeypatch.setattr(shred_module, "BATCH_CHARS", 100)
    parts = shred_module._page_batches(5, "<b>x</b>" * 30 + "y" * 250 + "<b>z</b>" * 5, None)
    assert max(p.num_rows for p in parts) == 10 and len(parts) == 8
    assert [i for p in parts for i in p.column("node_id").to_pylist()] == list(range(72))
