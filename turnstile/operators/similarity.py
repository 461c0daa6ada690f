"""Which siblings are alike — same tag, class sets of Jaccard 0.3 or
more, and sequences of child tags at most two edits apart.

Siblings of one form (classes and child tags) are one row. The child tags of
a parent become one character each, so Spark's ``levenshtein`` with a limit
measures edits of the sequence. Not every two sequences are compared: within
two edits of a string cut into three pieces, one piece stays as it is and
moves by two places at most, so a join on (length, piece) finds every pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnstile.operators.predicates import class_jaccard
from turnstile.session import materialize

# Fixed values
MIN_JACCARD, MAX_EDITS = 0.3, 2
PIECES = MAX_EDITS + 1


def _letter(number: Column) -> Column:
    """A character for each number, beyond all that are common."""
    return F.decode(F.unhex(F.lpad(F.hex(number + 0x10000), 8, "0")), "UTF-32")


def sibling_forms(m: DataFrame) -> DataFrame:
    """One row per form of siblings: page_id, parent_id, name, classes (set,
    sorted), kids (child tags, a character each), node_id (the first), n."""
    t = m.filter((F.col("kind") == "tag") & ~F.col("claimed") & F.col("parent_id").isNotNull())
    names = t.select("page_id", "name").distinct()
    letters = names.select("page_id", "name", _letter(
        F.row_number().over(Window.partitionBy("page_id").orderBy("name"))).alias("letter"))
    kids = (t.join(letters, ["page_id", "name"]).groupBy("page_id", F.col("parent_id").alias("node_id"))
            .agg(F.expr("listagg(letter, '') WITHIN GROUP (ORDER BY node_id)").alias("kids")))
    classes = F.array_sort(F.array_distinct(F.coalesce("classes", F.array().cast("array<string>"))))
    return (t.join(kids, ["page_id", "node_id"], "left")
            .groupBy("page_id", "parent_id", "name", classes.alias("classes"), F.coalesce("kids", F.lit("")).alias("kids"))
            .agg(F.min("node_id").alias("node_id"), F.count(F.lit(1)).alias("n")))


def _begin(length: Column, piece: int) -> Column:
    """Where a piece of a string of ``length`` begins; the pieces differ by one at most."""
    return F.floor(length * piece / PIECES).cast("int")


def close_strings(strings: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, a, b, edits: all pairs ``a <= b`` of different strings of equal
    keys at most ``MAX_EDITS`` apart (the shorter one first, then by order)."""
    s = strings.select(*keys, F.col(text).alias("s")).distinct().withColumn("l", F.length("s"))
    piece = lambda i: F.struct(
        F.lit(i).alias("i"), _begin(F.col("l"), i).alias("at"),
        F.substr("s", _begin(F.col("l"), i) + 1, _begin(F.col("l"), i + 1) - _begin(F.col("l"), i)).alias("piece"))
    index = s.select(*keys, F.col("s").alias("a"), F.col("l"), F.explode(F.array(*map(piece, range(PIECES)))).alias("p"))
    index = index.select(*keys, "a", "l", "p.i", "p.piece")
    # a string looks up the pieces that a string of its length or up to two less would have
    probe = (s.select(*keys, F.col("s").alias("b"), F.col("l").alias("lb"),
                      F.explode(F.sequence(F.greatest(F.col("l") - MAX_EDITS, F.lit(0)), "l")).alias("l"))
             .withColumn("i", F.explode(F.array(*map(F.lit, range(PIECES)))))
             .withColumn("shift", F.explode(F.sequence(F.lit(-MAX_EDITS), F.lit(MAX_EDITS)))))
    begin = sum((F.when(F.col("i") == i, _begin(F.col("l"), i)).otherwise(0) for i in range(PIECES)), F.lit(0))
    end = sum((F.when(F.col("i") == i, _begin(F.col("l"), i + 1)).otherwise(0) for i in range(PIECES)), F.lit(0))
    probe = probe.withColumn("at", begin + F.col("shift")).withColumn("size", end - begin)
    probe = (probe.filter("at >= 0 AND at + size <= lb")
             .select(*keys, "b", "lb", "l", "i", F.substr("b", F.col("at") + 1, F.col("size")).alias("piece")).distinct())
    pairs = (index.join(probe, [*keys, "l", "i", "piece"])
             .filter((F.col("a") != F.col("b")) & ((F.col("l") < F.col("lb")) | (F.col("a") < F.col("b"))))
             .select(*keys, "a", "b").distinct())
    return pairs.withColumn("edits", F.levenshtein("a", "b", MAX_EDITS)).filter("edits >= 0")


def alike_siblings(m: DataFrame) -> DataFrame:
    """page_id, parent_id, name, a, b (first nodes of two forms, a < b), n_a,
    n_b, jaccard, edits: every two forms of siblings that are alike."""
    forms = materialize(sibling_forms(m))
    keys = ["page_id", "parent_id", "name"]
    close = close_strings(forms, keys, "kids")
    same = forms.select(*keys, F.col("kids").alias("ka")).distinct().select(
        *keys, "ka", F.col("ka").alias("kb"), F.lit(0).alias("edits"))
    links = same.unionByName(close.select(*keys, F.col("a").alias("ka"), F.col("b").alias("kb"), "edits"))

    def side(s: str) -> DataFrame:
        return forms.select(*keys, F.col("kids").alias(f"k{s}"), F.col("classes").alias(f"c{s}"),
                            F.col("node_id").alias(s), F.col("n").alias(f"n_{s}"))
    jaccard = class_jaccard(F.col("ca"), F.col("cb"))
    pairs = (links.join(side("a"), [*keys, "ka"]).join(side("b"), [*keys, "kb"])
             .filter((F.col("a") != F.col("b")) & (jaccard >= MIN_JACCARD) & ((F.col("ka") != F.col("kb")) | (F.col("a") < F.col("b")))))
    swap = F.col("a") > F.col("b")
    pick = lambda x, y, name: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name)
    return pairs.select(*keys, pick("a", "b", "a"), pick("b", "a", "b"), pick("n_a", "n_b", "n_a"), pick("n_b", "n_a", "n_b"),
                        F.round(jaccard, 6).alias("jaccard"), "edits")
