"""Chat pages rendered from ``conversations`` by a Spark job (no Python per
row): one page per conversation and template. The truth for every page is
the ``conversations`` table itself, so SQL over it is the round-trip oracle.

Templates
* ``data_attr``  — ``div[data-testid=conversation-turn-N].<role>-turn``
* ``semantic``   — ``div.message.<role>-message``
* ``separator``  — plain ``div`` turns separated by ``hr``
* ``topology``   — ``div.chat > div.msg > div.content`` without role words
* ``studio``     — ``ms-chat-turn[data-turn-role] > div > ms-text-chunk`` (per-source rule)
* ``author``     — ``div[data-message-author-role] > div.markdown`` (per-source rule)
* ``elements``   — ``user-query`` / ``model-response`` ``> message-content`` (per-source rule)
* ``flux``       — one to four siblings a turn, turns separated by ``hr``
* ``markup``     — ``data_attr`` turns with lists, quotes, emphasis, links, images, a ragged table
Each page carries a role-marked nav and banner and a script as noise.
Assistant turns of the first two templates carry a planted code block,
diagram or formula, chosen by a hash of ``(conv_id, turn)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnstile.sources.tables import read_table

NAV = '<nav role="navigation"><a href="/">Home</a> <a href="/history">History</a></nav>'
BANNER = '<div role="banner">Saved chat</div>'
NAV_MD = "[Home](/) [History](/history)Saved chat"


def esc(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def plant_kind(conv: Column, turn: Column, role: Column) -> Column:
    h = F.substring(F.md5(F.concat(conv.cast("string"), F.lit(":"), turn.cast("string"))), 1, 1)
    return (F.when(role != "assistant", F.lit(None))
            .when(h.isin("0", "1", "2", "3"), F.lit("code"))
            .when(h.isin("4", "5", "6", "7"), F.lit("mermaid"))
            .when(h.isin("8", "9", "a", "b"), F.lit("math")))


def plant_html(kind: Column, conv: Column, turn: Column) -> Column:
    c, t = conv.cast("string"), turn.cast("string")
    return (F.when(kind == "code", F.concat(F.lit('<pre><code class="language-python">print('), c,
                                            F.lit(", "), t, F.lit(")</code></pre>")))
            .when(kind == "mermaid", F.concat(F.lit('<div class="diagram">graph TD\n  A[Turn '), t,
                                              F.lit("] --> B[Conv "), c, F.lit("]</div>")))
            .when(kind == "math", F.concat(
                F.lit('<p>Formula <span class="katex"><span class="katex-mathml"><math><semantics>'
                      '<mrow><mi>x</mi></mrow><annotation encoding="application/x-tex">x^'), t,
                F.lit(" + "), c,
                F.lit('</annotation></semantics></math></span><span class="katex-html" '
                      'aria-hidden="true">x</span></span> here.</p>')))
            .otherwise(F.lit("")))


def _turn_html(template: str) -> Column:
    conv, turn, role = F.col("conv_id"), F.col("turn"), F.col("role")
    text = esc(F.col("text"))
    plant = plant_html(plant_kind(conv, turn, role), conv, turn)
    if template == "data_attr":
        return F.concat(F.lit('<div data-testid="conversation-turn-'), turn.cast("string"),
                        F.lit('" class="'), role, F.lit('-turn"><div class="markdown"><p>'), text,
                        F.lit("</p>"), plant, F.lit("</div></div>"))
    if template == "semantic":
        return F.concat(F.lit('<div class="message '), role, F.lit('-message"><p>'), text, F.lit("</p>"),
                        plant, F.lit("</div>"))
    if template == "separator":
        return F.concat(F.when(turn > 0, F.lit("<hr>")).otherwise(F.lit("")), F.lit("<div>"), text,
                        F.lit("</div>"))
    if template == "topology":
        return F.concat(F.lit('<div class="msg"><div class="content">'), text, F.lit("</div></div>"))
    if template == "studio":
        label = F.when(role == "user", F.lit("User")).when(role == "assistant", F.lit("Model")) \
                 .otherwise(F.lit("System"))
        return F.concat(F.lit('<ms-chat-turn data-turn-role="'), label, F.lit('"><div class="turn-container">'
                              '<ms-text-chunk><p>'), text, F.lit("</p></ms-text-chunk></div></ms-chat-turn>"))
    if template == "author":
        return F.concat(F.lit('<div data-message-author-role="'), role, F.lit('" data-message-id="'), turn.cast("string"),
                        F.lit('"><div class="markdown"><p>'), text, F.lit("</p></div></div>"))
    if template == "elements":
        name = F.when(role == "user", F.lit("user-query")).when(role == "assistant", F.lit("model-response")).otherwise(F.lit("aside"))
        return F.concat(F.lit("<"), name, F.lit('><div class="box"><message-content><p>'), text,
                        F.lit("</p></message-content></div></"), name, F.lit(">"))
    if template == "flux":
        more = (conv + turn) % 4
        return F.concat(F.when(turn > 0, F.lit("<hr>")).otherwise(F.lit("")), F.lit("<p>"), text, F.lit("</p>"),
                        F.when(more >= 1, F.concat(F.lit("<div>second of "), turn.cast("string"), F.lit("</div>"))).otherwise(F.lit("")),
                        F.when(more >= 2, F.lit("<ul><li>third</li></ul>")).otherwise(F.lit("")),
                        F.when(more >= 3, F.concat(F.lit("<p>fourth <b>"), conv.cast("string"), F.lit("</b></p>"))).otherwise(F.lit("")))
    if template == "markup":
        t = turn.cast("string")
        return F.concat(
            F.lit('<div data-testid="conversation-turn-'), t, F.lit('" class="'), role, F.lit('-turn"><div class="markdown"><p>'), text,
            F.lit("</p><ul><li>one "), t, F.lit("</li><li><strong>two</strong></li></ul><ol><li>x</li></ol><blockquote> outer<blockquote><p>inner "),
            conv.cast("string"), F.lit('</p> </blockquote></blockquote><p><em>em</em> <code>co</code><br>after '
                                       '<img src="/i.png" alt="pic"> <a href="/u"> link </a></p><hr>'
                                       "<table><tr><th>h1</th><th>h2</th></tr><tr><td>"), t,
            F.lit("</td></tr><tr><td>a</td><td><b>b</b></td><td>c</td></tr></table></div></div>"))
    raise ValueError(template)


def chat_pages(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    """pages(page_id, url, html) with page_id = conv_id."""
    return pages_of(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), template)


def pages_of(turns: DataFrame, template: str) -> DataFrame:
    """The same of given turns (conv_id, turn, role, text)."""
    t = turns.withColumn("h", _turn_html(template))
    g = t.groupBy("conv_id").agg(F.expr("listagg(h, '') WITHIN GROUP (ORDER BY turn)").alias("turns"))
    inner = F.col("turns")
    if template == "topology":
        inner = F.concat(F.lit('<div class="chat">'), inner, F.lit("</div>"))
    cid = F.col("conv_id").cast("string")
    html = F.concat(F.lit("<!DOCTYPE html><html><head><title>Chat "), cid,
                    F.lit("</title><script>var c="), cid, F.lit(";</script></head><body>"),
                    F.lit(NAV + BANNER), F.lit("<main>"), inner, F.lit("</main></body></html>"))
    return g.select(F.col("conv_id").alias("page_id"),
                    F.concat(F.lit(f"https://chat.example/{template}/"), cid).alias("url"), html.alias("html"))
