"""End-to-end extraction on small hand-written pages (our own structures;
what is expected follows from the rules)."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import pages_df
from turnstile.operators import roles as R
from turnstile.operators.extract import Options, extract, prepare
from turnstile.operators.markdown import to_markdown
from turnstile.operators.protect import KEY_PATTERN
from turnstile.operators.render import render_json, render_markdown

GENERIC = """<section id="thread"><article><span>tools</span>
  <div class="row user-row"><p>Which tide table covers the northern harbour in spring?</p></div>
  <div class="row model-row"><p>The blue booklet lists every harbour, spring tides included.</p></div>
</article></section>"""

STUDIO = """<main><x-turn data-n="1"><x-bubble role="user"><section><p>How deep is the basin at low water</p>
<p>and does the bar shift after storms</p><p>in an ordinary winter</p></section></x-bubble></x-turn>
<x-turn data-n="2"><x-bubble role="model"><section><p>Four metres at the quay on most days</p>
<p>the bar moves west by a boat length</p><p>and comes back with the summer swell</p></section></x-bubble></x-turn></main>"""

KATEX = ('<article><h4>Pendulum</h4><p>Its period is <b class="katex"><i><math><mrow><mi>T</mi></mrow>'
         '<annotation encoding="application/x-tex">T = 2\\pi\\sqrt{L/g}</annotation></math></i></b> for small swings.</p></article>')

MERMAID = ('<section class="thread"><p>}}%% graph TD<br>  Quay((Quay)) ==> Lock{Lock open}<br>'
           '  Lock -- tide in --> Basin[/Basin/]<br>  Lock -- tide out --> Roads[Roads]</p></section>')

SIBLINGS = """<main id="log"><section class="entry">cast off</section>
<section class="entry">hoist the jib</section><section class="chart">index</section></main>"""


@pytest.fixture(scope="module")
def topo(spark):
    pages = [(1, GENERIC), (2, STUDIO), (3, KATEX), (4, MERMAID)]
    ex = extract(pages_df(spark, pages), Options(detector="topo"))
    return {"turns": [r.asDict() for r in ex.turns.orderBy("page_id", "idx").collect()],
            "protected": [r.asDict() for r in ex.protected.collect()],
            "md": {r.page_id: r.markdown for r in render_markdown(ex.turns).collect()},
            "json": {r.page_id: r.json for r in render_json(ex.turns).collect()}}


def _page(res, pid):
    return [t for t in res["turns"] if t["page_id"] == pid]


def test_generic_two_turns_deepest_level(topo):
    t = _page(topo, 1)
    assert len(t) == 2
    assert [(x["role"], x["confidence"]) for x in t] == [("user", 0.4), ("model", 0.5)]
    assert t[0]["content"].strip().startswith("Which tide table")


def test_studio_export_blocks(topo):
    t = _page(topo, 2)
    assert len(t) >= 2
    assert all(len(x["content"].strip()) > 5 for x in t)


def test_katex_math_protected(topo):
    maths = [p for p in topo["protected"] if p["page_id"] == 3 and p["ptype"] == "math"]
    assert len(maths) == 1
    assert maths[0]["formatted"] == "$T = 2\\pi\\sqrt{L/g}$"
    assert re.fullmatch(KEY_PATTERN, maths[0]["key"])
    assert "$T = 2\\pi\\sqrt{L/g}$" in " ".join(x["content"] for x in _page(topo, 3))


def test_mermaid_prefix_stripped_and_fenced(topo):
    merm = [p for p in topo["protected"] if p["page_id"] == 4 and p["ptype"] == "mermaid"]
    assert len(merm) == 1
    assert merm[0]["raw"].startswith("graph TD")
    doc = topo["md"][4]
    assert "```mermaid" in doc and "graph TD" in doc


def test_render_markdown_and_json(topo):
    doc = topo["md"][1]
    assert doc.startswith("## User\n\n") and "## MODEL" in doc and "tide table" in doc
    assert "\n\n\n" not in doc.replace("\n\n\n\n", "")
    import json
    j = json.loads(topo["json"][1])
    assert [t["role"] for t in j["session"]["turns"]] == ["user", "model"]
    assert j["session"]["turns"][0]["content"][0]["type"] == "text"


def test_clustering_siblings_min_density_one(spark):
    ex = extract(pages_df(spark, [(9, SIBLINGS)]), Options(detector="topo", min_density=1))
    t = ex.turns.orderBy("idx").collect()
    assert [x.content.strip() for x in t] == ["cast off", "hoist the jib"]


def test_each_markdown_rule(spark):
    k1, k2 = "__TSK_MATH_00ff00ff00ff00ff__", "__TSK_CODE_89abcdef89abcdef__"
    bodies = {
        "<p>Tide at  noon</p><p>and at six</p>": "\nTide at  noon\n\nand at six\n",
        "<table><tr><th>port</th><th>depth</th><th>pilot</th></tr><tr><td>Brest</td><td>11</td></tr>"
        "<tr><td>Ostend</td><td>8</td><td>Ann</td><td>late</td></tr><tr></tr></table>":
            "\n| port | depth | pilot |\n| --- | --- | --- |\n| Brest | 11 |  |\n| Ostend | 8 | Ann |\n|  |  |  |\n",
        f"<p>from {k1} to</p><div><span> {k2}\n</span></div><p>{k1}{k2}</p>": f"\nfrom {k1} to\n {k2}\n\n{k1}{k2}\n",
        "<blockquote>\n log <p>wind</p>rising </blockquote>": "\n> log \n> wind\n> rising\n",
        '<a href="/chart"> the <em>chart</em> </a><a href="/bare"></a><a>no target</a>': "[the *chart*](/chart)/bareno target",
        '<img src="buoy.gif"><img alt="none"><img src="q.png" alt="quay wall">': "![](buoy.gif)![quay wall](q.png)",
        "<h4>Moorings</h4><ol><li>bow<ul><li>spring</li></ul></li><li>stern</li></ol><hr><b>slack</b><i>tide</i><br>ebb":
            "\n#### Moorings\n\n1. bow\n- spring\n\n\n1. stern\n\n\n---\n**slack***tide*  \nebb",
    }
    pages = [(k, f"<html><body>{b}</body></html>") for k, b in enumerate(bodies)]
    m, *_ = prepare(pages_df(spark, pages), Options(raw=True))
    body = m.filter("kind = 'tag' AND name = 'body'").select("page_id", F.lit(0).alias("block_idx"), "node_id", F.lit(False).alias("nr"))
    got = {r.page_id: r.content for r in to_markdown(m, body).collect()}
    assert got == dict(enumerate(bodies.values()))
    numbered = {r.page_id: r.content for r in to_markdown(m, body, numbered=True).collect()}
    assert "1. bow\n- spring\n\n\n2. stern\n" in numbered[6]


def test_code_key_and_restore(spark):
    page = '<html><body><div><pre><code class="language-py">print("hi")</code></pre></div></body></html>'
    ex = extract(pages_df(spark, [(1, page)]), Options(detector="heuristic"))
    p = ex.protected.collect()
    assert len(p) == 1 and p[0].ptype == "code" and p[0].raw == 'print("hi")'
    assert re.fullmatch(r"__TSK_CODE_[0-9a-f]{16}__", p[0].key)
    content = ex.turns.collect()[0].content
    assert '``` py\nprint("hi")\n```' in content and "__TSK_" not in content


def test_roles_of_marked_and_unmarked_blocks(spark):
    """Words in classes and code mark a role; what has no mark follows from the block before."""
    blocks = [(0, "", False, "user", 0.4), (1, "", False, "model", 0.5), (2, "bubble human-side", False, "user", 0.8), (3, "", False, "model", 0.5),
              (4, "ai-model reply", False, "model", 0.8), (5, "x", False, "user", 0.5), (6, "prompt user", False, "user", 0.8)]
    df = spark.createDataFrame([b[:3] for b in blocks], "idx int, cls string, code boolean")
    u, m = R.role_scores(F.col("cls"), F.col("code"))
    df = df.withColumn("strong", R.strong_role(u, m)).withColumn("page_id", F.lit(5))
    got = [(r.idx, r.role, r.confidence) for r in R.alternate(df, ["page_id"], "idx").orderBy("idx").collect()]
    assert got == [(i, role, c) for i, _, _, role, c in blocks]


def test_no_body_auto_gives_no_turns_and_fallback(spark):
    pages = [(1, GENERIC), (2, "<html><body><div>Plain page with a handful of words in it</div></body></html>")]
    ex = extract(pages_df(spark, pages), Options(detector="auto"))
    t = {r.page_id: r for r in ex.turns.collect()}
    assert 1 not in t            # no body: validation fails and there is no body to fall back on
    assert t[2].content.strip() == "Plain page with a handful of words in it"


def test_data_latex_attribute_math(spark):
    page = ('<html><body><div><p>Ratio <span data-latex="\\frac{a}{b}">a/b</span> holds here</p>'
            '</div></body></html>')
    ex = extract(pages_df(spark, [(1, page)]), Options(detector="heuristic", data_latex=True))
    p = ex.protected.collect()
    assert [(r.ptype, r.formatted) for r in p] == [("math", "$\\frac{a}{b}$")]
    assert ex.turns.collect()[0].content.strip() == "Ratio $\\frac{a}{b}$ holds here"


def test_signature_detector_format_and_short_readmit(spark):
    from turnstile.operators.extract import prepare
    from turnstile.operators.topology import signatures
    page = ('<html><body><div role="row" data-testid="bar"></div><div id="t">'
            '<div class="message msg-a1b2c3d4"><p>first message with enough words</p><p>x</p></div>'
            '<div class="message msg-99887766ff"><p>second message with enough words here</p><p>y</p></div>'
            '<div class="message msg-aabbccdd"><p>ok</p><p>z</p></div>'
            '</div></body></html>')
    m, *_ = prepare(pages_df(spark, [(1, page)]), Options())
    sig = {r.sig for r in signatures(m).collect()}
    assert "div[message+msg](p:2)" in sig and "div[]()role=row;testid=bar" in sig
    ex = extract(pages_df(spark, [(1, page)]), Options(detector="signature"))
    got = [r.content.strip() for r in ex.turns.orderBy("idx").collect()]
    assert got == ["first message with enough words\n\nx", "second message with enough words here\n\ny",
                   "ok\n\nz"]


def test_regroup_fragments_by_message(spark):
    from turnstile.operators.extract import regroup
    page = ('<div class="chat"><div class="message user-msg"><p>para one words here</p><p>para two words here</p>'
            '</div><div class="message bot-msg"><p>para three words here</p><p>para four words here</p></div></div>')
    ex = extract(pages_df(spark, [(1, page)]), Options(detector="topo"))
    assert ex.turns.count() == 4
    got = [(r.role, r.confidence, r.content.strip()) for r in regroup(ex).orderBy("idx").collect()]
    assert got == [("user", 0.8, "para one words here\n\npara two words here"),
                   ("model", 0.5, "para three words here\n\npara four words here")]


def test_code_without_language_class(spark):
    page = "<html><body><div><pre><code>x = 1</code></pre><p>after the code block</p></div></body></html>"
    ex = extract(pages_df(spark, [(1, page)]), Options(detector="heuristic"))
    p = ex.protected.collect()
    assert [(r.ptype, r.language, r.formatted) for r in p] == [("code", "", "``` \nx = 1\n```")]
    assert "``` \nx = 1\n```" in ex.turns.collect()[0].content
