"""Column functions shared by the plans (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NL = "\n"


def py_words(c: Column | str) -> Column:
    """Word count with Python ``str.split()`` semantics (Unicode spaces)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda x: x != ""))


def py_strip(c: Column | str) -> Column:
    """``str.strip()``: Spark's ``trim`` only removes ASCII spaces."""
    c = F.col(c) if isinstance(c, str) else c
    # one run from the first to the last that is no space; nothing is tried at each character
    return F.regexp_extract(c, r"(?sU)^\s*+(.*\S|)", 1)


def squeeze_once(c: Column) -> Column:
    """O83 (package form): one left-to-right pass turning three newlines into two."""
    return F.replace(c, F.lit("\n\n\n"), F.lit("\n\n"))


def squeeze_runs(c: Column) -> Column:
    """O83 (legacy form): any run of 3+ newlines becomes two, then strip."""
    return py_strip(squeeze_newlines(c))


def squeeze_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


# Fixed values (O25): UI label lines removed from finished text. The pattern
# is the line-anchored, case-insensitive alternation below.
UI_LABEL_LINES = (
    r"^(vous avez dit\s*:?|chatgpt a dit\s*:?|gemini a dit\s*:?|claude a dit\s*:?|"
    r"assistant\s*:?|user\s*:?|human\s*:?|ai\s*:?|model\s*:?|"
    r"réflexion durant.*?secondes?\s*\.?|thinking\s*\.*)$"
)


def strip_ui_labels(c: Column) -> Column:
    # (?d): only "\n" ends a line, as in the reference's regex engine
    return F.regexp_replace(c, "(?imdu)" + UI_LABEL_LINES, "")


def latex_dollars(c: Column) -> Column:
    """``\\\\(x\\\\)`` -> ``$x$``, ``\\[x\\]`` -> block ``$$x$$``, then
    single ``\\(`` / ``\\)`` -> ``$`` (legacy post-processing order)."""
    c = F.regexp_replace(c, r"(?d)\\\\\((.*?)\\\\\)", r"\$$1\$")
    c = F.regexp_replace(c, r"(?s)\\\[(.*?)\\\]", "\n\n\\$\\$$1\\$\\$\n\n")
    c = F.regexp_replace(c, r"\\\(", r"\$")
    return F.regexp_replace(c, r"\\\)", r"\$")


def preview(c: Column, n: int = 120) -> Column:
    """First ``n`` characters, newlines as spaces, then an ellipsis."""
    return F.concat(F.replace(F.substring(c, 1, n), F.lit("\n"), F.lit(" ")), F.lit("..."))


def fmt2(c: Column) -> Column:
    return F.format_string("%.2f", c)
