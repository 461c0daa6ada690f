"""Column text functions on inputs that contain the patterns."""

from pyspark.sql import functions as F

from turnstile.functions.text import latex_dollars, py_words, squeeze_once, squeeze_runs, strip_ui_labels


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("o")).first().o


def test_ui_labels(spark):
    s = "Vous avez dit :\nBonjour\nASSISTANT:\nthinking...\nAnswer stays\nuser said hi"
    assert one(spark, strip_ui_labels, s) == "\nBonjour\n\n\nAnswer stays\nuser said hi"


def test_latex_delimiters(spark):
    s = r"a \\(x\\) b \[y^2\] c \(z\) d"
    assert one(spark, latex_dollars, s) == "a $x$ b \n\n$$y^2$$\n\n c $z$ d"


def test_squeeze_forms(spark):
    s = "a\n\n\n\nb\n\n\nc\n"
    assert one(spark, squeeze_once, s) == "a\n\n\nb\n\nc\n"
    assert one(spark, squeeze_runs, s) == "a\n\nb\n\nc"


def test_unicode_word_split(spark):
    assert one(spark, py_words, "a b  c\n d ") == 4


def test_chunked_alternation_equals_plain(spark):
    from turnstile.operators import roles as R
    import random
    random.seed(7)
    rows = [(c, i, random.choice(["user", "model", None, None, None])) for c in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, strong string")
    a = sorted(tuple(r) for r in R.alternate(df, ["conv_id"], "turn").collect())
    b = sorted(tuple(r) for r in R.alternate(df, ["conv_id"], "turn", chunk=5).collect())
    assert a == b


def test_mermaid_paragraph_wrap(spark):
    from turnstile.operators.predicates import wrap_mermaid
    f = lambda c: squeeze_runs(wrap_mermaid(c))  # noqa: E731  (the legacy path squeezes after wrapping)
    assert one(spark, f, "intro\n\ngraph TD\nA-->B\n\nend") == "intro\n\n```mermaid\ngraph TD\nA-->B\n```\n\nend"
    # one line only, or already fenced: left alone
    assert one(spark, f, "intro\n\npie chart\n\nend") == "intro\n\npie chart\n\nend"
    assert one(spark, f, "```\ngraph TD\nA\n```") == "```\ngraph TD\nA\n```"
