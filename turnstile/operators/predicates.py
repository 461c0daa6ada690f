"""Small node predicates and helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values (O20): UI keywords matched inside class names, and UI tag names.
UI_CLASS_WORDS = ["button", "nav", "footer", "header", "menu", "tooltip", "copy"]
UI_TAG_NAMES = ["button", "nav", "footer", "header"]
# Fixed values (O27): role-signal words in attribute values or early text.
ROLE_SIGNAL = r"(?i)user|human|assistant|model|ai[-_]?message|turn|prompt|response|vous"
# Fixed values (O38): diagram keywords that open an unfenced paragraph.
MERMAID_OPEN = ("graph|flowchart|sequenceDiagram|classDiagram|stateDiagram|erDiagram|gantt|pie|gitGraph|"
                "journey|C4Context|mindmap|timeline")
# Fixed values (O95): page source from the URL host.
SOURCE_RULES = [("chatgpt.com", "chatgpt"), ("chat.openai.com", "chatgpt"), ("claude.ai", "claude"),
                ("gemini.google.com", "gemini"), ("aistudio.google.com", "aistudio"),
                ("chat.deepseek.com", "deepseek"), ("grok.com", "grok"), ("x.com", "grok")]


def is_ui_element(classes: Column, name: Column) -> Column:
    """A class containing a UI keyword, or a UI tag name."""
    cls = F.coalesce(classes, F.array().cast("array<string>"))
    hit = F.exists(cls, lambda c: F.lower(c).rlike("|".join(UI_CLASS_WORDS)))
    return hit | name.isin(*UI_TAG_NAMES)


def is_empty_node(ne_col: Column) -> Column:
    """No non-whitespace text in the subtree."""
    return ne_col == 0


def has_role_signal(attrs: Column, text: Column) -> Column:
    """Attribute values plus the first 200 characters of text."""
    vals = F.concat_ws(" ", F.coalesce(F.map_values(attrs), F.array().cast("array<string>")))
    return F.concat_ws(" ", vals, F.substring(F.coalesce(text, F.lit("")), 1, 200)).rlike(ROLE_SIGNAL)


def scrub_attrs(attrs: Column) -> Column:
    """Drop attribute names starting with ``_`` or ``ng-``."""
    return F.map_filter(attrs, lambda k, v: ~(k.startswith("_") | k.startswith("ng-")))


def class_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two class sets."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / u)


def wrap_mermaid(text: Column) -> Column:
    """Text from a line that opens with a diagram keyword up to a blank
    line, a heading line or the end is wrapped in a mermaid fence, unless it
    has fewer than two lines or holds a fence already. What lies between the
    matches and the matches themselves are put together in turn."""
    pattern = (r"(?isdU)(?:\A|\n)((?:" + MERMAID_OPEN + r")\s.*?)(?=\n\n|\n#|\n?\z)")
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def wrap(m):
        body = F.regexp_replace(m, r"(?U)^\s+|\s+$", "")
        lines = F.size(F.split(body, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"))
        return F.when(body.contains("```") | (lines < 2), m).otherwise(
            F.concat(F.lit("\n\n```mermaid\n"), body, F.lit("\n```\n")))
    pieces = F.zip_with(between, F.transform(found, wrap), lambda b, m: F.concat(b, F.coalesce(m, F.lit(""))))
    return F.when(F.size(found) == 0, text).otherwise(F.array_join(pieces, ""))


def source_of(spark, pages: DataFrame) -> DataFrame:
    """Host of the URL joined to a fixed rule table (8 rows, broadcast)."""
    rules = spark.createDataFrame(SOURCE_RULES, "host string, source string")
    host = F.lower(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))
    p = pages.select("page_id", host.alias("host"))
    return p.join(F.broadcast(rules), "host", "left").select(
        "page_id", "host", F.coalesce("source", F.lit("generic")).alias("source"))


# Marks that tell where a page was saved, and their weights. A mark is a
# host, a tag's name, an attribute or a class; a page counts each once.
SOURCE_MARKS = ([("host", h, s, 4) for h, s in SOURCE_RULES] + [
    ("tag", "ms-chat-turn", "aistudio", 3), ("tag", "ms-text-chunk", "aistudio", 1),
    ("attr", "data-turn-role", "aistudio", 1),
    ("attr", "data-message-author-role", "chatgpt", 3), ("attr", "data-message-id", "chatgpt", 1),
    ("tag", "user-query", "gemini", 3), ("tag", "model-response", "gemini", 3), ("tag", "message-content", "gemini", 1),
    ("class", "font-claude-message", "claude", 3), ("class", "font-user-message", "claude", 2),
    ("class", "ds-message", "deepseek", 3), ("class", "response-content-markdown", "grok", 2)])


def source_votes(m: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, source, votes for each source that a page has a mark of:
    the marks on its nodes (``m``) and its url's host, joined to the fixed
    table of marks (some twenty rows, broadcast)."""
    spark = m.sparkSession
    marks = F.broadcast(spark.createDataFrame(SOURCE_MARKS, "kind string, mark string, source string, weight int"))
    tag = m.filter(F.col("kind") == "tag")
    found = lambda kind, c: F.transform(c, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("mark")))
    none = F.array().cast("array<string>")
    held = tag.select("page_id", F.explode(F.concat(
        found("tag", F.array("name")), found("attr", F.coalesce(F.map_keys("attrs"), none)),
        found("class", F.coalesce("classes", none)))).alias("h")).select("page_id", "h.kind", "h.mark")
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))
    held = held.unionByName(pages.select(F.col("page_id").cast("long").alias("page_id"), F.lit("host").alias("kind"), host.alias("mark")))
    # the join drops what is no mark before anything is shuffled
    return (held.join(marks, ["kind", "mark"]).select("page_id", "kind", "mark", "source", "weight").distinct()
            .groupBy("page_id", "source").agg(F.sum("weight").cast("long").alias("votes")))


def winning_source(votes: DataFrame) -> DataFrame:
    """page_id, source, votes of the source with most votes (of equals the first by name)."""
    best = F.struct((-F.col("votes")).alias("v"), F.col("source").alias("s"))
    return votes.groupBy("page_id").agg(F.min(best).alias("b")).select(
        "page_id", F.col("b.s").alias("source"), (-F.col("b.v")).alias("votes"))
