"""Legacy pipeline: UI noise strip, parent scoring, role vote, marker."""

from conftest import pages_df
from turnstile.operators.legacy import legacy_extract, render_legacy

LONG_U = "could you please explain how the scheduler decides which task runs first today"
LONG_M = ("the scheduler keeps a queue ordered by priority and picks the head of that queue "
          "whenever a worker becomes free, then it updates the statistics")

PAGE = f"""<html><body><nav>Menu Home</nav>
<div class="toolbar"><span>Copy</span></div>
<div id="thread">
  <div class="turn user-turn"><div>User</div><p>{LONG_U}</p></div>
  <div class="turn model-turn"><div>Model</div><p>{LONG_M}</p></div>
  <div class="turn user-turn"><p>{LONG_U} again please</p></div>
</div><footer>c 2024</footer></body></html>"""


def test_legacy_blocks_roles_and_render(spark):
    out = legacy_extract(pages_df(spark, [(1, PAGE)]))
    rows = out.orderBy("idx").collect()
    assert [r.label for r in rows] == ["User", "Model", "User"]
    assert LONG_U in rows[0].content and not rows[0].content.startswith("User")
    assert all(r.confidence > 0.5 for r in rows)
    doc = render_legacy(out).first().markdown
    assert doc.startswith("## User\n") and "## Model\n" in doc and "Menu" not in doc and "Copy" not in doc


TURN1 = ('<div class="turn model-turn"><h2>Title <em>x</em></h2><p>Some <strong>bold <em>it</em></strong> and '
         '<code>c()</code> with <a href="http://u">link <b>t</b></a> and <a>plain</a>.</p>'
         '<ul><li> one </li><li><p>two</p></li></ul><blockquote><p>q1</p><p>q2</p></blockquote>'
         '<pre class="x"><code class="language-js">let a = 1;</code></pre>'
         '<table><tr><th>A</th><th>B</th></tr><tr><td>1</td></tr></table></div>')
TURN2 = f'<div class="turn user-turn"><p>{LONG_U}</p></div>'


def test_legacy_conversion_rules(spark):
    page = f"<html><body><div id='thread'>{TURN1}{TURN2}</div></body></html>"
    rows = legacy_extract(pages_df(spark, [(1, page)])).orderBy("idx").collect()
    assert [r.label for r in rows] == ["Model", "User"]
    assert rows[0].content == (
        "## Titlex\n\nSome **bold it** and `c()` with [linkt](http://u) and plain.\n\n- one\n- two\n\n"
        "> q1\n> \n> q2\n\n```js\nlet a = 1;\n```\n\n| A | B |\n| --- | --- |\n| 1 |")
    assert rows[1].content == LONG_U
