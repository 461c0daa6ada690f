"""Markdown conversion as an ordered event stream per block.

Every node in a block subtree yields pieces: a tag gives an opening and a
closing string (chosen by tag name, O69-O76), a text node gives its text.
Sorting the pieces by ``(position, open/close, depth)`` and concatenating
them (``listagg ... WITHIN GROUP``) is the recursive conversion.

Handlers that are not compositional:
* a tag whose stripped text is one placeholder becomes that placeholder (O68);
* a table becomes GFM built from its rows and cells (O78);
* links and quotes (O75, O77) strip their converted inner text, and quotes
  prefix its lines. This needs no round for each nesting level
  (``render_pieces``): white space goes if nothing else stands between it and
  an edge of the innermost element around it (an outer one's edge is never
  nearer), and a line break gets one prefix for each quote around it. Both are
  running values over a block's ordered pieces, so the number of jobs doesn't
  depend on how deep a page nests. Only pieces within such elements take part:
  the others are what they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnstile.functions.text import py_strip
from turnstile.operators.dom import enclosing, enclosing_root, has_marked_ancestor, subtree_text
from turnstile.session import materialize

TEXT_KINDS = ["text", "comment", "script", "style", "template", "declaration", "pi"]
NONCOMP = ["a", "blockquote"]
ORDER = "k1, k2, k3, src"


def _open_close(tables: bool, numbered: bool) -> tuple[Column, Column]:
    name = F.col("name")
    level = F.substring(name, 2, 1)
    is_h = name.isin("h1", "h2", "h3", "h4", "h5", "h6")
    src, alt = F.col("_src"), F.col("_alt")
    op = (F.when(name.isin("p", "ul", "ol"), F.lit("\n"))
          .when(is_h, F.concat(F.lit("\n"), F.repeat(F.lit("#"), level.cast("int")), F.lit(" ")))
          .when(name == "li", F.when(F.col("parent_name") == "ol", F.concat(
              F.col("_item").cast("string") if numbered else F.lit("1"), F.lit(". "))).otherwise(F.lit("- ")))
          .when(name == "br", F.lit("  \n"))
          .when(name == "hr", F.lit("\n---\n"))
          .when(name.isin("strong", "b"), F.lit("**"))
          .when(name.isin("em", "i"), F.lit("*"))
          .when(name == "code", F.lit("`"))
          .when(name == "img", F.when(src != "", F.concat(F.lit("!["), alt, F.lit("]("), src, F.lit(")")))
                .otherwise(F.lit("")))
          .when((name == "table") & F.lit(not tables), F.lit("\n"))
          .otherwise(F.lit("")))
    cl = (F.when(name.isin("p", "ul", "ol", "li"), F.lit("\n"))
          .when(is_h, F.lit("\n"))
          .when(name.isin("strong", "b"), F.lit("**"))
          .when(name.isin("em", "i"), F.lit("*"))
          .when(name == "code", F.lit("`"))
          .when((name == "table") & F.lit(not tables), F.lit("\n"))
          .otherwise(F.lit("")))
    return op, cl


def block_members(m: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, node) rows for every node in each block subtree; blocks may nest.
    A subtree is the run of ids from its root to its ``end``, which ``blocks``
    may bring along."""
    if "end" not in blocks.columns:
        blocks = blocks.join(m.select("page_id", "node_id", "end"), ["page_id", "node_id"])
    b = blocks.select("page_id", F.col("node_id").alias("root"), "end", "block_idx", "nr")
    mem = (b.select("page_id", "root", "block_idx", "nr", F.explode(F.sequence("root", "end")).alias("node_id"))
           .join(m, ["page_id", "node_id"]))
    return mem.filter(~F.col("claimed") & ~(F.col("nr") & F.col("in_noise")))


def _gfm_tables(mem: DataFrame) -> DataFrame:
    """(page_id, block_idx, node_id=table, piece) for outermost tables."""
    tw = Window.partitionBy("page_id", "block_idx").orderBy("node_id")
    t = mem.withColumn("_tbl", enclosing_root(F.col("outer_tbl"), tw)).filter(F.col("_tbl").isNotNull())
    keys = ["page_id", "block_idx"]
    tag = F.col("kind") == "tag"
    trs = t.filter(tag & (F.col("name") == "tr")).select(*keys, "_tbl", F.col("node_id").alias("tr"))
    is_cell = tag & F.col("name").isin("td", "th")
    cell_row = (enclosing(t, tag & (F.col("name") == "tr"), is_cell, keys, proper=True)
                .select(*keys, F.col("node_id").alias("cell"), F.col("mark_id").alias("tr")).join(trs, keys + ["tr"]))
    texty = t.filter(((F.col("kind") == "text") & (F.col("nonempty") > 0)) | F.col("key").isNotNull())
    ctext = (subtree_text(texty, t.filter(is_cell), F.coalesce("key", py_strip(F.col("text"))), keys=keys)
             .select(*keys, F.col("node_id").alias("cell"), F.col("txt").alias("ct")))
    rows = (cell_row.join(ctext, keys + ["cell"], "left")
            .groupBy(*keys, "_tbl", "tr")
            .agg(F.sort_array(F.collect_list(F.struct("cell", F.coalesce("ct", F.lit("")).alias("ct"))))
                 .alias("cs")))
    rows = trs.join(rows, keys + ["_tbl", "tr"], "left").select(
        *keys, "_tbl", "tr", F.transform(F.coalesce("cs", F.array().cast("array<struct<cell:int,ct:string>>")),
                                         lambda x: x["ct"]).alias("cells"))
    per = rows.groupBy(*keys, "_tbl").agg(F.sort_array(F.collect_list(F.struct("tr", "cells"))).alias("rs"))
    hdr = F.col("rs")[0]["cells"]
    n = F.size(hdr)
    line = lambda cs: F.concat(F.lit("| "), F.array_join(cs, " | "), F.lit(" |"))
    sep = line(F.array_repeat(F.lit("---"), n))
    body = F.transform(F.slice("rs", 2, 1 << 30),
                       lambda r: line(F.slice(F.concat(r["cells"], F.array_repeat(F.lit(""), n)), 1, n)))
    lines = F.concat(F.array(line(hdr), sep), body)
    gfm = F.concat(F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"))
    out = per.select(*keys, F.col("_tbl").alias("node_id"), gfm.alias("piece"))
    tables = mem.filter("outer_tbl").select(*keys, "node_id")
    return tables.join(out, keys + ["node_id"], "left").select(
        *keys, "node_id", F.coalesce("piece", F.lit("")).alias("piece"))


def to_markdown(m: DataFrame, blocks: DataFrame, tables: bool = True, numbered: bool = False) -> DataFrame:
    """blocks(page_id, block_idx, node_id, nr) -> (page_id, block_idx, content)
    with placeholders still in place (see ``protect.restore``). ``numbered``:
    items of an ordered list are counted up instead of all being 1."""
    keys = ["page_id", "block_idx"]
    attr = lambda k: F.coalesce(F.col("attrs")[k], F.lit("")).alias(f"_{k}")
    mem = block_members(m.select("page_id", "node_id", "kind", "name", "parent_id", "parent_name", "depth", "end", "text", "nonempty",
                                 "key", "claimed", "in_noise", "ne_f", "ne_n", "keys_f", "keys_n",
                                 attr("src"), attr("alt"), attr("href")), blocks)
    bw = Window.partitionBy(*keys).orderBy("node_id")
    tag = F.col("kind") == "tag"
    nr = F.col("nr")
    only_key = tag & F.when(nr, (F.col("ne_n") == 1) & (F.col("keys_n") == 1)).otherwise(
        (F.col("ne_f") == 1) & (F.col("keys_f") == 1))
    mem = mem.select(*keys, "node_id", "root", "kind", "name", "parent_id", "parent_name", "depth", "end", "text", "nonempty", "key",
                     "_src", "_alt", "_href", only_key.alias("_ok"))
    mem = mem.withColumn("_ok_anc", has_marked_ancestor(F.col("_ok"), bw))
    # a wrapper whose only text is one placeholder stands for that placeholder
    mem = mem.withColumn("_ok_rid", enclosing_root(F.col("_ok") & ~F.col("_ok_anc"), bw))
    if tables:
        mem = mem.withColumn("_tblm", tag & (F.col("name") == "table") & ~F.col("_ok") & ~F.col("_ok_anc"))
        mem = mem.withColumn("_tbl_anc", has_marked_ancestor(F.col("_tblm"), bw))
        mem = materialize(mem.withColumn("outer_tbl", F.col("_tblm") & ~F.col("_tbl_anc")).drop("_tblm"))
    else:
        mem = mem.withColumns({"_tbl_anc": F.lit(False), "outer_tbl": F.lit(False)})
    live = mem.filter(~F.col("_tbl_anc") & ~F.col("outer_tbl"))
    if numbered:
        is_item = tag & (F.col("name") == "li") & ~F.col("_ok_anc")
        live = live.withColumn("_item", F.sum(is_item.cast("int")).over(
            Window.partitionBy(*keys, "parent_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)))
    op, cl = _open_close(tables, numbered)
    is_nc = F.col("name").isin(*NONCOMP)
    none = F.lit(None).cast("string")
    mark, href = F.when(is_nc, F.col("name")), F.when(F.col("name") == "a", F.col("_href"))
    step = F.when(is_nc, 1).otherwise(0)

    def event(k1, k2, k3, src, piece, mark=none, href=none, side=F.lit(0)):
        piece = F.coalesce(piece, F.lit(""))
        return F.struct(k1.alias("k1"), F.lit(k2).alias("k2"), k3.alias("k3"), src.alias("src"), piece.alias("piece"),
                        mark.alias("mark"), href.alias("href"), side.alias("side"))
    node, depth = F.col("node_id"), F.col("depth")
    opening = event(node, 0, depth, node, F.when(is_nc, F.lit("")).otherwise(op), mark, href, step)
    closing = event(F.col("end"), 1, -depth, node, F.when(is_nc, F.lit("")).otherwise(cl), mark, href, -step)
    # the one placeholder of a wrapper is put where the wrapper opens
    only = F.array(event(F.col("_ok_rid"), 0, depth, F.col("_ok_rid"), F.col("key")))
    events = (F.when(F.col("_ok_rid").isNotNull() & F.col("key").isNotNull(), only)
              .when(~F.col("_ok_anc") & F.col("kind").isin(*TEXT_KINDS), F.array(event(node, 0, depth, node, F.col("text"))))
              .when(~F.col("_ok_anc") & ~F.col("_ok") & tag, F.array(opening, closing)))
    # empty pieces say nothing but that there is a block
    said = (F.col("_v.piece") != "") | (F.col("_v.side") != 0) | (F.col("_v.src") == F.col("root"))
    ev = live.select(*keys, "root", F.explode(events).alias("_v")).filter(said).select(*keys, "_v.*")
    if tables:
        ev = ev.unionByName(_gfm_tables(mem).join(mem.filter("outer_tbl").select(*keys, "node_id", "depth"), keys + ["node_id"]).select(
            *keys, F.col("node_id").alias("k1"), F.lit(0).alias("k2"), F.col("depth").alias("k3"),
            F.col("node_id").alias("src"), "piece", *no_mark("href")))
    return _with_links_and_quotes(ev, keys)


# ---- ordered pieces to text: keys, k1, k2, k3, src, piece, mark, side (1 opens, -1 closes, 0 neither) ----
def no_mark(*others: str) -> list[Column]:
    """The marker columns of a piece that is no marker."""
    return [F.lit(None).cast("string").alias(c) for c in ("mark", *others)] + [F.lit(0).alias("side")]


LEAD = r"(?U)^\s*"
TRAIL = r"(?U)\s*$"


def _solid(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def _with_links_and_quotes(ev: DataFrame, keys: list[str]) -> DataFrame:
    """keys, content: the pieces of the markers, and all put together. An element
    is empty if nothing but white space is in it; a link in it that has a
    target isn't nothing, empty or not."""
    along = Window.partitionBy(*keys).orderBy("k1", "k2", "k3", "src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    solid = F.when(F.col("side") == 0, _solid(F.col("piece"))).otherwise((F.col("side") == 1) & _solid(F.coalesce("href", F.lit(""))))
    x = materialize(_around(ev, keys, ["href", F.sum(solid.cast("int")).over(along).alias("_n")]))
    within = x.filter(WITHIN)
    filled = (within.filter("side <> 0").groupBy(*keys, "src").agg((F.max("_n") > F.min("_n")).alias("_filled")))
    within = within.join(filled, [*keys, "src"], "left")
    full, opens, link = F.col("_filled"), F.col("side") == 1, F.col("mark") == "a"
    named = link & (F.col("href") != "")
    piece = (F.when(F.col("side") == 0, F.col("piece"))
             .when(named & full & opens, F.lit("[")).when(named & full, F.concat(F.lit("]("), F.col("href"), F.lit(")")))
             .when(named & opens, F.col("href"))
             .when(~link & full & opens, F.lit("\n> ")).when(~link & full, F.lit("\n")).otherwise(F.lit("")))
    return _put_together(x, within.withColumn("piece", piece), keys, False)


def _around(ev: DataFrame, keys: list[str], more: list | None = None) -> DataFrame:
    """The pieces with their place (``_i``) and the number of elements, quotes
    and cells around them; a marker lies outside its own element."""
    order = ["k1", "k2", "k3", "src"]
    w = Window.partitionBy(*keys).orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    side, quote, cell = F.col("side"), F.col("mark") == "blockquote", F.col("mark") == "#cell"
    around = lambda c: (F.coalesce(F.sum(F.when(c & (side == 1), 1).otherwise(0)).over(before), F.lit(0))
                        - F.sum(F.when(c & (side == -1), 1).otherwise(0)).over(upto)).cast("int")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return ev.select(*keys, *order, "piece", "mark", "side", F.row_number().over(w).alias("_i"),
                     around(side != 0).alias("_level"), around(yes(quote)).alias("_quotes"), around(yes(cell)).alias("_cells"),
                     *(more or []))


def render_pieces(ev: DataFrame, keys: list[str], cells: bool = False) -> DataFrame:
    """keys, content: the pieces put together in order. Within an element that
    has markers (``mark``, ``side``) the text is stripped; in quotes each line
    break gets a prefix for each quote around it; with ``cells``, line breaks
    within an element marked ``#cell`` are spaces (after the quotes inside it)."""
    x = materialize(_around(ev, keys))
    return _put_together(x, x.filter(WITHIN), keys, cells)


#: Pieces in elements with markers, and the markers; all others stay as they are.
WITHIN = "_level > 0 OR side <> 0"


def _put_together(x: DataFrame, within: DataFrame, keys: list[str], cells: bool) -> DataFrame:
    """keys, content of all pieces ``x`` (``_around``); those of ``within`` are
    read from there and stripped and prefixed by the elements around them."""
    order = ["k1", "k2", "k3", "src"]
    plain = x.filter(f"NOT ({WITHIN})").select(*keys, *order, "piece")
    side, cell = F.col("side"), F.col("mark") == "#cell"
    yes = lambda c: F.coalesce(c, F.lit(False))
    x = within.select(*keys, *order, "piece", "mark", "side", "_i", "_level", "_quotes", "_cells", _solid(F.col("piece")).alias("_solid"))
    wi = Window.partitionBy(*keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    wd = Window.partitionBy(*keys).orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, -1)
    at = F.when(F.col("_solid"), F.col("_i"))
    x = x.withColumns({"_prev": F.coalesce(F.max(at).over(wi), F.lit(0)),
                       "_next": F.coalesce(F.min(at).over(wd), F.lit((1 << 31) - 1))})
    # a marker is a piece at its element's outside and a bound one level further in
    row = lambda level, asked: F.struct(level.alias("level"), F.lit(asked).alias("asked"))
    here = row(F.col("_level"), True)
    x = x.withColumn("_e", F.explode(F.when(side != 0, F.array(here, row(F.col("_level") + 1, False))).otherwise(F.array(here))))
    bound = ~F.col("_e.asked")
    wl = Window.partitionBy(*keys, "_e.level").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    wr = Window.partitionBy(*keys, "_e.level").orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"_open": F.last(F.when(bound & (side == 1), F.col("_i")), ignorenulls=True).over(wl),
                       "_close": F.last(F.when(bound & (side == -1), F.col("_i")), ignorenulls=True).over(wr)})
    if cells:
        wc = Window.partitionBy(*keys, "_cell").orderBy("_i", "_e.asked").rowsBetween(Window.unboundedPreceding, 0)
        x = x.withColumn("_cell", F.when(bound & yes(cell), F.col("_cells") + 1).otherwise(F.col("_cells")))
        outside = F.last(F.when(bound & yes(cell) & (side == 1), F.col("_quotes")), ignorenulls=True).over(wc)
        x = x.withColumn("_outside", outside)
    x = x.filter("_e.asked")
    inside = F.col("_level") > 0
    no_lead = inside & ((F.col("_prev") <= F.col("_open")) | (~F.col("_solid") & (F.col("_next") >= F.col("_close"))))
    no_trail = inside & (F.col("_next") >= F.col("_close"))
    core = py_strip(F.col("piece"))
    kept = F.concat(F.when(no_lead, F.lit("")).otherwise(F.regexp_extract("piece", LEAD, 0)), core,
                    F.when(no_trail | ~F.col("_solid"), F.lit("")).otherwise(F.regexp_extract("piece", TRAIL, 0)))
    prefix = lambda n: F.repeat(F.lit("> "), n)
    lines = F.replace(kept, F.lit("\n"), F.concat(F.lit("\n"), prefix(F.col("_quotes"))))
    if cells:
        flat = F.replace(kept, F.lit("\n"), F.concat(F.lit(" "), prefix(F.col("_quotes") - F.coalesce("_outside", F.lit(0)))))
        lines = F.when(F.col("_cells") > 0, flat).otherwise(lines)
    return (plain.unionByName(x.select(*keys, *order, lines.alias("piece"))).groupBy(*keys)
            .agg(F.expr(f"listagg(piece, '') WITHIN GROUP (ORDER BY {ORDER})").alias("content")))
