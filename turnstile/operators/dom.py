"""Set-form tree tests over ``dom_nodes`` (nested-set ``[node_id, end]``).

Subtrees are contiguous runs of ``node_id`` inside a page, so "walk the
tree" questions become one ordered window per page, with no theta join:

* a node has a marked proper ancestor  <=>  some earlier marked row has
  ``end >= node_id``  (running ``max(end)`` over preceding rows);
* for marks that never nest (outermost roots), the enclosing root is the
  last marked row at or before the node, if its ``end`` covers the node;
* subtree totals are prefix-sum differences: ``S(end) - S(node_id - 1)``,
  one window plus one equi-join on ``(page_id, end)``;
* marks that may nest: the number of marked nodes around a node is the running
  count of marks opened minus marks closed, and the mark of level ``l`` around
  it is the last one of that level that opened before it (``enclosing``). Rows
  multiply by the marks that hold a node, never by its depth in the tree;
* the text of a subtree is one slice of the page's text (``subtree_text``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnstile.session import materialize


def page_window(*part: str, order: str = "node_id"):
    return Window.partitionBy(*(part or ("page_id",))).orderBy(order)


def has_marked_ancestor(mark: Column, w=None) -> Column:
    w = (w or page_window()).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(F.when(mark, F.col("end"))).over(w) >= F.col("node_id"), F.lit(False))


def enclosing_root(mark: Column, w=None) -> Column:
    """Id of the enclosing marked row (self included) for non-nesting marks."""
    w = (w or page_window()).rowsBetween(Window.unboundedPreceding, 0)
    rid = F.last(F.when(mark, F.col("node_id")), ignorenulls=True).over(w)
    rend = F.last(F.when(mark, F.col("end")), ignorenulls=True).over(w)
    return F.when(F.col("node_id") <= rend, rid)


def subtree_sums(df: DataFrame, cols: dict[str, Column], keys=("page_id",), carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the sum of each contribution over its subtree ``[node_id, end]``.
    Returns ``keys + node_id``, one ``sum_<name>`` column per entry and the
    columns ``carry`` of ``df``. Only rows with something below them look up
    the running sums at their end; the others are their own sum."""
    keys = list(keys)
    base = df.select(*keys, "node_id", "end", *carry, *[c.cast("long").alias(n) for n, c in cols.items()])
    w = Window.partitionBy(*keys).orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    cum = base.select(*keys, "node_id", "end", *carry, *cols.keys(),
                      *[F.sum(n).over(w).alias(f"c_{n}") for n in cols])
    cum = materialize(cum)  # read twice; otherwise all that lies before it runs twice
    at_end = cum.select(*keys, F.col("node_id").alias("end"),
                        *[F.col(f"c_{n}").alias(f"e_{n}") for n in cols])
    below = (cum.filter(F.col("end") > F.col("node_id")).select(*keys, "node_id", "end").join(at_end, keys + ["end"])
             .drop("end"))
    j = cum.join(below, keys + ["node_id"], "left")
    return j.select(*keys, "node_id", *carry,
                    *[(F.coalesce(F.col(f"e_{n}"), F.col(f"c_{n}")) - F.col(f"c_{n}") + F.col(n))
                      .alias(f"sum_{n}") for n in cols])


def glued_words(words: Column, nonempty: Column) -> Column:
    """Words of ``get_text(strip=True)``: stripped strings are joined with no
    separator, so each junction glues two words into one."""
    return words - F.greatest(nonempty - 1, F.lit(0))


def enclosing(df: DataFrame, mark: Column, point: Column | None = None, keys=("page_id",), proper: bool = False,
              nearest: bool = False) -> DataFrame:
    """For each row with ``point`` (default: every row) the rows with ``mark``
    whose subtree holds it, outermost at level 1: ``keys + node_id``,
    ``level``, ``mark_id``. ``proper`` leaves a row's own mark out;
    ``nearest`` gives the innermost mark only. ``df``: keys, node_id, end."""
    keys = list(keys)
    point = F.lit(True) if point is None else point
    yes = lambda c: F.coalesce(c, F.lit(False))
    rows = df.select(*keys, "node_id", "end", yes(mark).alias("_mark"), yes(point).alias("_point")).filter("_mark OR _point")
    opens = rows.select(*keys, "node_id", F.lit(0).alias("_k"), F.col("_mark").cast("int").alias("_step"), "_mark", "_point")
    closes = rows.filter("_mark").select(*keys, F.col("end").alias("node_id"), F.lit(1).alias("_k"), F.lit(-1).alias("_step"),
                                         F.lit(False).alias("_mark"), F.lit(False).alias("_point"))
    along = Window.partitionBy(*keys).orderBy("node_id", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = opens.unionByName(closes).withColumn("_level", F.sum("_step").over(along)).filter("_k = 0 AND _level > 0")
    last = F.col("_level") - F.col("_mark").cast("int") if proper else F.col("_level")
    first = last if nearest else F.lit(1).cast("long")
    at = lambda l, asked: F.struct(l.cast("long").alias("level"), F.lit(asked).alias("asked"))
    none = F.array().cast("array<struct<level:bigint,asked:boolean>>")
    own = F.when(F.col("_mark"), F.array(at(F.col("_level"), False))).otherwise(none)
    asks = F.when(F.col("_point") & (last > 0), F.transform(F.sequence(first, last), lambda l: at(l, True))).otherwise(none)
    x = x.select(*keys, "node_id", F.explode(F.concat(own, asks)).alias("_e")).select(*keys, "node_id", "_e.*")
    within = Window.partitionBy(*keys, "level").orderBy("node_id", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.last(F.when(~F.col("asked"), F.col("node_id")), ignorenulls=True).over(within)
    return x.withColumn("mark_id", found).filter("asked").select(*keys, "node_id", "level", "mark_id")


def subtree_text(rows: DataFrame, targets: DataFrame, text: Column, sep: str = "", keys=("page_id",)) -> DataFrame:
    """``keys + node_id``, ``txt``: the texts of the rows in each target's
    subtree in order, ``sep`` between them; targets without any are left out.

    ``rows``: keys, node_id and what ``text`` reads; ``targets``: keys,
    node_id, end. A page's pieces are joined once, and each target is a slice
    of them by running sums of lengths in bytes, so nested targets cost no
    more than what they return."""
    keys = list(keys)
    piece = F.concat(F.coalesce(text, F.lit("")), F.lit(sep)).cast("binary")
    none, zero = F.lit(None).cast("int"), F.lit(0).cast("long")
    event = lambda at, k: F.struct(F.col(at).alias("_at"), F.lit(k).alias("_k"))
    # pieces between the targets' begins (0) and ends (2): each side is read once, and both meet in one exchange
    pieces = rows.select(*keys, F.col("node_id").alias("_at"), F.lit(1).alias("_k"), none.alias("node_id"), piece.alias("_t"))
    cuts = (targets.select(*keys, "node_id", F.explode(F.array(event("node_id", 0), event("end", 2))).alias("_e"))
            .select(*keys, "_e._at", "_e._k", "node_id", F.lit(None).cast("binary").alias("_t")))
    along = Window.partitionBy(*keys).orderBy("_at", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = pieces.unionByName(cuts).withColumn("_sum", F.sum(F.coalesce(F.octet_length("_t").cast("long"), zero)).over(along))
    side = lambda k: F.array_sort(F.collect_list(F.when(F.col("_k") == k, F.struct("node_id", "_sum"))))
    per = events.groupBy(*keys).agg(F.expr("listagg(_t) WITHIN GROUP (ORDER BY _at)").alias("_whole"),
                                    side(0).alias("_from"), side(2).alias("_to")).filter("size(_from) > 0")
    spans = F.array_distinct(F.zip_with("_from", "_to", lambda a, b: F.struct(
        a["node_id"].alias("node_id"), a["_sum"].alias("a"), b["_sum"].alias("b"))))
    cut = F.transform(F.filter(spans, lambda c: c["b"] > c["a"]), lambda c: F.struct(c["node_id"].alias("node_id"), F.substring(
        F.col("_whole"), (c["a"] + 1).cast("int"), (c["b"] - c["a"] - len(sep.encode())).cast("int")).cast("string").alias("txt")))
    return per.select(*keys, F.explode(cut).alias("_c")).select(*keys, "_c.node_id", "_c.txt")
