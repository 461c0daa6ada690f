"""One-pass Markdown and interval questions against plain recursion over the
same trees, on pages of random nesting."""

import random

from pyspark.sql import functions as F

from conftest import pages_df
from turnstile.operators.dom import enclosing, subtree_text
from turnstile.operators.extract import Options, prepare
from turnstile.operators.legacy_markdown import legacy_to_markdown
from turnstile.operators.markdown import to_markdown
from turnstile.operators.shred import _page_columns

WORDS = ["alpha", "beta gamma", " ", "\n", " delta\nepsilon ", "x", "  zeta  ", "\n\n", "two\n\nlines"]


def random_page(rng, tags, depth=7):
    def node(d):
        if d == 0 or rng.random() < 0.3:
            return rng.choice(WORDS)
        tag = rng.choice(tags)
        if tag in ("br", "hr"):
            return f"<{tag}>"
        href = rng.choice(['', ' href=""', ' href="/u"', ' href=" "', ' href="/a\nb"']) if tag == "a" else ""
        return f"<{tag}{href}>{''.join(node(d - 1) for _ in range(rng.randint(0, 3)))}</{tag}>"
    return "<body>" + "".join(node(depth) for _ in range(rng.randint(1, 4))) + "</body>"


def tree(html):
    cols, error = _page_columns(1, html)
    assert error is None
    rows = [dict(zip(cols, v)) for v in zip(*cols.values())]
    for r in rows:
        r["attrs"] = dict(r["attrs"] or ())
        r["kids"] = [k for k in rows if k["parent_id"] == r["node_id"]]
    return rows


def inner(n, rule):
    return "".join(rule(k) for k in n["kids"])


def markdown_rule(n):
    if n["kind"] != "tag":
        return n["text"] or ""
    name, t = n["name"], inner(n, markdown_rule)
    if name == "a":
        href, s = n["attrs"].get("href", ""), t.strip()
        return f"[{s}]({href})" if s and href else s or href
    if name == "blockquote":
        s = t.strip()
        return "\n> " + s.replace("\n", "\n> ") + "\n" if s else ""
    if name in ("p", "ul", "ol"):
        return f"\n{t}\n"
    if name == "li":
        return ("1. " if n["parent_name"] == "ol" else "- ") + t + "\n"
    if name[0] == "h" and name[1:].isdigit():
        return f"\n{'#' * int(name[1])} {t}\n"
    return {"strong": f"**{t}**", "em": f"*{t}*", "br": "  \n", "hr": "\n---\n"}.get(name, t)


def node_blocks(m, name="body"):
    return m.filter((F.col("kind") == "tag") & (F.col("name") == name)).select(
        "page_id", F.lit(0).alias("block_idx"), "node_id", F.lit(False).alias("nr"))


def jobs(spark, run):
    """How many jobs an action runs."""
    group = f"count-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    return n


def test_markdown_of_random_nesting(spark):
    rng = random.Random(7)
    tags = ["a", "blockquote", "p", "strong", "em", "ul", "li", "ol", "h2", "div", "br", "hr", "a", "blockquote"]
    pages = [(k, random_page(rng, tags)) for k in range(150)]
    pages.append((900, "<body>" + "<blockquote>q\n" * 60 + "deep" + "</blockquote>" * 60 + "</body>"))
    m, *_ = prepare(pages_df(spark, pages), Options(raw=True))
    got = {r.page_id: r.content for r in to_markdown(m, node_blocks(m), tables=False).collect()}
    for k, html in pages:
        body = next(n for n in tree(html) if n["name"] == "body")
        assert got.get(k, "") == inner(body, markdown_rule), html


def legacy_rule(n, in_table=False):
    if n["kind"] != "tag":
        return n["text"] or ""
    name = n["name"]
    if name == "table":
        return legacy_table(n)
    t = inner(n, lambda k: legacy_rule(k, in_table))
    if in_table and name in ("td", "th"):
        return t.strip().replace("\n", " ")
    if name in ("p", "div", "section", "article"):
        return f"\n{t.strip()}\n"
    if name == "li":
        return f"\n- {t.strip()}"
    if name == "blockquote":
        return "\n> " + t.strip().replace("\n", "\n> ") + "\n"
    return {"br": "\n", "hr": "\n---\n"}.get(name, t + "\n" if name in ("ul", "ol") else t)


def below(n):
    for k in n["kids"]:
        yield k
        yield from below(k)


def legacy_table(n):
    if sum(k["name"] == "table" for k in below(n)) > 2:
        return ""
    rows = {}

    def walk(k, tr):
        for c in k["kids"]:
            if c["name"] in ("td", "th"):
                rows.setdefault(tr, []).append(legacy_rule(c, True))
            elif c["name"] not in ("p", "div", "section", "article", "li", "blockquote", "table"):
                walk(c, c["node_id"] if c["name"] == "tr" else tr)
    walk(n, -1)
    if not rows:
        return ""
    lines = ["| " + " | ".join(rows[k]) + " |" for k in sorted(rows)]
    sep = "| " + " | ".join(["---"] * max(x.count("|") - 1 for x in lines)) + " |"
    return "\n" + lines[0] + "\n" + sep + "\n" + "\n".join(lines[1:]) + "\n"


def legacy_pages():
    rng = random.Random(11)
    tags = ["p", "div", "li", "ul", "blockquote", "table", "tr", "td", "tr", "td", "span", "br", "section", "table"]
    pages = [(k, random_page(rng, tags)) for k in range(150)]
    cell = "<table><tr><td>a\nb</td><td>{}</td></tr><tr><td>c</td></tr></table>"
    deep = "x|y"
    for k in range(4):  # three nested tables and more give nothing
        deep = cell.format(deep)
        pages.append((500 + k, f"<body><p>before</p>{deep}<blockquote>{deep}</blockquote></body>"))
    pages.append((600, "<body>" + "<div><blockquote>q\n" * 25 + "deep" + "</blockquote></div>" * 25 + "</body>"))
    return pages


def test_legacy_markdown_of_random_nesting(spark):
    from turnstile.functions.text import py_strip, squeeze_newlines, strip_ui_labels
    pages = legacy_pages()
    m, *_ = prepare(pages_df(spark, pages), Options(raw=True))
    t = m.withColumn("gone", F.lit(False))
    got = {r.page_id: r.content for r in legacy_to_markdown(t, node_blocks(t)).collect()}
    want = []
    for k, html in pages:
        body = next(n for n in tree(html) if n["name"] == "body")
        want.append((k, inner(body, legacy_rule)))
    df = spark.createDataFrame(want, "page_id long, raw string")
    rule = {r.page_id: r.t for r in df.select("page_id", py_strip(strip_ui_labels(squeeze_newlines(F.col("raw")))).alias("t")).collect()}
    for k, html in pages:
        assert got.get(k, "") == rule[k], html


def test_jobs_do_not_grow_with_nesting(spark):
    def run(depth):
        html = "<body>" + '<blockquote><a href="/x">q' * depth + "</a></blockquote>" * depth + "</body>"
        m, *_ = prepare(pages_df(spark, [(1, html)]), Options(raw=True))
        return jobs(spark, lambda: to_markdown(m, node_blocks(m)).collect()), \
            jobs(spark, lambda: legacy_to_markdown(m.withColumn("gone", F.lit(False)), node_blocks(m)).collect())
    shallow, deep = run(2), run(25)
    assert deep[0] <= shallow[0] + 2 and deep[1] <= shallow[1] + 2  # adaptive execution may split a stage more


def test_enclosing_and_subtree_text(spark):
    rng = random.Random(5)
    pages = [(k, random_page(rng, ["div", "b", "i", "div"], 6)) for k in range(60)]
    m, *_ = prepare(pages_df(spark, pages), Options(raw=True))
    div = (F.col("kind") == "tag") & (F.col("name") == "div")
    every = {}
    for r in enclosing(m, div).collect():
        every.setdefault((r.page_id, r.node_id), []).append((r.level, r.mark_id))
    proper = {(r.page_id, r.node_id): r.mark_id for r in enclosing(m, div, proper=True, nearest=True).collect()}
    text = {(r.page_id, r.node_id): r.txt for r in subtree_text(
        m.filter(F.col("kind") == "text"), m.filter(div), F.col("text"), "é|").collect()}
    for k, html in pages:
        rows = tree(html)
        for n in rows:
            up, at = [], n
            while at is not None:
                up.append(at)
                at = rows[at["parent_id"]] if at["parent_id"] is not None else None
            marks = [a["node_id"] for a in reversed(up) if a["name"] == "div"]
            assert sorted(every.get((k, n["node_id"]), [])) == [(i + 1, a) for i, a in enumerate(marks)]
            above = [a for a in marks if a != n["node_id"]]
            assert proper.get((k, n["node_id"])) == (above[-1] if above else None)
            if n["name"] == "div":
                own = [c["text"] for c in rows[n["node_id"]:n["end"] + 1] if c["kind"] == "text"]
                assert text.get((k, n["node_id"])) == ("é|".join(own) if own else None)


def test_deep_page_in_linear_rows(spark):
    """65,000 unclosed elements: rows and memory grow with the nodes."""
    cols, error = _page_columns(1, "<b>" * 65_000)
    assert error is None and len(cols["node_id"]) == 65_001
    assert cols["gparent_id"][-1] == 64_998 and not any(isinstance(c[-1], list) and len(c[-1]) > 10 for c in cols.values())
    m, *_ = prepare(pages_df(spark, [(1, "<b>" * 20_000 + "end")]), Options(raw=True))
    last = m.filter(F.col("text") == "end").select("depth", "parent_id").first()
    assert (last.depth, last.parent_id) == (20_001, 20_000)
