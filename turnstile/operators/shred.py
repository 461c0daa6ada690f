"""Page shred — HTML string -> ``dom_nodes`` rows.

This is the only tree-building step. It runs as one ``mapInArrow`` job over
the ``pages`` table (one task per input split, each page parsed on its own
with the standard-library tokenizer) and returns flat rows. Everything after
it is DataFrame code.

Tree contract (fixed; tested in tests/test_shred.py):
* an end tag closes up to the nearest open element of that name; an end tag
  with no open element of that name is ignored;
* void elements never get children; ``<x/>`` opens and closes ``x``;
* no implied closing (an open ``p`` is not closed by the next ``p``);
* a text run made only of ASCII whitespace becomes a single ``"\\n"`` (if it
  held a newline) or ``" "``, except inside ``pre``/``textarea``;
* node 0 is the document; ``depth`` counts ancestors (document included);
* ``end`` is the id of the last node in the subtree (nested-set interval
  ``[node_id, end]``); ``gparent_id`` is the parent's parent. Questions about
  further ancestors are windows over the intervals (``dom.enclosing``), so a
  page's rows grow with its nodes, whatever its depth.
"""

from __future__ import annotations

import traceback
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from turnstile.session import materialize

# Elements that never have children.
VOID_ELEMENTS = frozenset([
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen",
    "link", "menuitem", "meta", "param", "source", "track", "wbr",
    "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid",
    "spacer",
])
# Elements whose whitespace-only text is kept verbatim.
KEEP_WHITESPACE = frozenset(["pre", "textarea"])
# Elements whose inner strings are not page text.
STRING_CONTAINERS = ("script", "style", "template")
ASCII_SPACE = " \n\t\f\r"

NODE_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("node_id", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("parent_id", T.IntegerType()),
    T.StructField("parent_name", T.StringType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("gparent_id", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("words", T.IntegerType()),
    T.StructField("nonempty", T.IntegerType()),
    T.StructField("src_start", T.IntegerType()),
    T.StructField("src_end", T.IntegerType()),
    T.StructField("error", T.StringType()),
])

_ARROW_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("node_id", pa.int32()), ("kind", pa.string()),
    ("name", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
    ("classes", pa.list_(pa.string())), ("parent_id", pa.int32()),
    ("parent_name", pa.string()), ("depth", pa.int32()), ("end", pa.int32()),
    ("gparent_id", pa.int32()), ("text", pa.string()),
    ("words", pa.int32()), ("nonempty", pa.int32()), ("src_start", pa.int32()), ("src_end", pa.int32()),
    ("error", pa.string()),
])


class _RowBuilder(HTMLParser):
    """Turns one page into node rows (lists of column values)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.at = 0  # characters read so far (for source spans, O92)
        self.starts: list[int] = []
        self.src_ends: list[int] = []
        self.buf_start = 0
        self.ids: list[int] = []
        self.kinds: list[str] = []
        self.names: list[str | None] = []
        self.attrs: list[list[tuple[str, str]] | None] = []
        self.classes: list[list[str] | None] = []
        self.parents: list[int | None] = []
        self.pnames: list[str | None] = []
        self.depths: list[int] = []
        self.ends: list[int] = []
        self.gparents: list[int | None] = []
        self.texts: list[str | None] = []
        self.stack: list[int] = []          # open element ids, document first
        self.stack_names: list[str] = []
        self.open_count: dict[str, int] = {}
        self.void_open: dict[str, int] = {}     # void elements whose end tag hasn't come, by name
        self.containers: list[str] = []         # open elements whose strings have a kind of their own
        self.keep_space = 0                     # open elements that keep white space
        self.buf: list[str] = []
        self._add("document", "#document", None, None, None)
        self.stack.append(0)
        self.stack_names.append("#document")

    # -- row emission -------------------------------------------------
    def updatepos(self, i: int, j: int) -> int:
        if j > i:
            self.at += j - i
        return j

    def _here(self) -> int:
        return self.at

    def _add(self, kind, name, attrs, classes, text, start=None, end=None) -> int:
        nid = len(self.ids)
        at = self._here() if start is None else start
        self.starts.append(at)
        self.src_ends.append(at if end is None else end)
        parent = self.stack[-1] if self.stack else None
        self.ids.append(nid)
        self.kinds.append(kind)
        self.names.append(name)
        self.attrs.append(attrs)
        self.classes.append(classes)
        self.parents.append(parent)
        self.pnames.append(self.stack_names[-1] if self.stack_names else None)
        self.depths.append(len(self.stack))
        self.ends.append(nid)
        self.gparents.append(self.stack[-2] if len(self.stack) > 1 else None)
        self.texts.append(text)
        return nid

    def _flush(self) -> None:
        if not self.buf:
            return
        s = "".join(self.buf)
        self.buf = []
        if not self.keep_space and not s.strip(ASCII_SPACE):
            s = "\n" if "\n" in s else " "
        kind = self.containers[-1] if self.containers else "text"
        self._add(kind, None, None, None, s, start=self.buf_start, end=self._here())

    def _push(self, nid: int, name: str) -> None:
        self.stack.append(nid)
        self.stack_names.append(name)
        self.open_count[name] = self.open_count.get(name, 0) + 1
        self.keep_space += name in KEEP_WHITESPACE
        if name in STRING_CONTAINERS:
            self.containers.append(name)

    def _pop(self, src_end: int | None = None) -> str:
        nid = self.stack.pop()
        name = self.stack_names.pop()
        self.open_count[name] -= 1
        self.keep_space -= name in KEEP_WHITESPACE
        if name in STRING_CONTAINERS:
            self.containers.pop()
        self.ends[nid] = len(self.ids) - 1
        self.src_ends[nid] = self._here() if src_end is None else src_end
        return name

    # -- tokenizer callbacks -----------------------------------------
    def handle_starttag(self, tag, attrs, self_closing=False):
        self._flush()
        amap: dict[str, str] = {}
        for k, v in attrs:
            amap[k] = "" if v is None else v
        classes = amap["class"].split() if "class" in amap else []
        raw = self.get_starttag_text() or ""
        here = self._here()
        nid = self._add("tag", tag, list(amap.items()), classes, None, start=here, end=here + len(raw))
        if self_closing:
            return
        if tag in VOID_ELEMENTS:
            self.void_open[tag] = self.void_open.get(tag, 0) + 1
            return
        self._push(nid, tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, self_closing=True)

    def handle_endtag(self, tag):
        self._flush()
        if self.void_open.get(tag):
            self.void_open[tag] -= 1
            return
        if not self.open_count.get(tag):
            return
        here = self._here()
        while len(self.stack) > 1:
            if self.stack_names[-1] == tag:
                self._pop(here + len(tag) + 3)
                break
            self._pop(here)

    def handle_data(self, data):
        if not self.buf:
            self.buf_start = self._here()
        self.buf.append(data)

    def handle_comment(self, data):
        self._flush()
        self._add("comment", None, None, None, data)

    def handle_decl(self, decl):
        self._flush()
        self._add("doctype", None, None, None, decl)

    def unknown_decl(self, data):
        self._flush()
        if data.startswith("CDATA["):
            self._add("text", None, None, None, data[len("CDATA["):])
        else:
            self._add("declaration", None, None, None, data)

    def handle_pi(self, data):
        self._flush()
        self._add("pi", None, None, None, data)

    def finish(self, total: int = 0) -> None:
        self.close()
        self._flush()
        while len(self.stack) > 1:
            self._pop(total)
        self.ends[0] = len(self.ids) - 1
        self.src_ends[0] = total


def _page_columns(page_id: int, html: str | None):
    html = html or ""
    b = _RowBuilder()
    err = None
    try:
        b.feed(html)
        b.finish(len(html))
    except Exception:  # quarantine, never fail the job on one page
        err = traceback.format_exc(limit=3)
    n = len(b.ids)
    words, nonempty = [], []
    for k, t in zip(b.kinds, b.texts):
        if t is None:
            words.append(0)
            nonempty.append(0)
        else:
            w = len(t.split())
            words.append(w)
            nonempty.append(1 if w else 0)
    cols = {
        "page_id": [page_id] * n, "node_id": b.ids, "kind": b.kinds,
        "name": b.names, "attrs": b.attrs, "classes": b.classes,
        "parent_id": b.parents, "parent_name": b.pnames, "depth": b.depths,
        "end": b.ends, "gparent_id": b.gparents, "text": b.texts, "words": words,
        "nonempty": nonempty, "src_start": b.starts, "src_end": b.src_ends, "error": [None] * n,
    }
    return cols, err


#: Rows and text of a batch that a task hands on; a page of more comes in several.
BATCH_ROWS, BATCH_CHARS = 16_384, 2_000_000
#: Whole pages that cross into Python at a time, so that a worker's memory doesn't grow with its task's.
BATCH_PAGES = 500
#: Characters of html by which the node rows are dealt out, about 200,000 rows a partition.
PART_CHARS = 4_000_000


def _error_columns(page_id: int, html: str | None, error: str) -> dict[str, list]:
    """The page's own row in the quarantine, its html as the text."""
    return {f.name: [None] for f in _ARROW_SCHEMA} | {"page_id": [page_id], "kind": ["error"], "text": [html], "error": [error]}


def _batch(cols: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(cols, schema=_ARROW_SCHEMA)


def _pieces(cols: dict[str, list]) -> list[pa.RecordBatch]:
    """A long page's rows in several batches."""
    out, lo, size, n = [], 0, 0, len(cols["page_id"])
    for i in range(n):
        size += len(cols["text"][i] or "") + sum(len(k) + len(v) for k, v in cols["attrs"][i] or ())
        if i + 1 == n or i + 1 - lo == BATCH_ROWS or size >= BATCH_CHARS:
            out.append(_batch({k: v[lo:i + 1] for k, v in cols.items()}))
            lo, size = i + 1, 0
    return out


def _checked(page_id: int, html: str | None, max_nodes: int | None) -> dict[str, list]:
    """A page's rows, or its error row: whatever fails for one page is its error."""
    try:
        cols, error = _page_columns(page_id, html)
        n = len(cols["page_id"])
        if error is None and max_nodes is not None and n > max_nodes:
            error = f"more than {max_nodes} nodes"
    except Exception:  # quarantine, never fail the job on one page
        error = traceback.format_exc(limit=3)
    return cols if error is None else _error_columns(page_id, html, error)


def _together(pages: list[tuple[int, str | None, dict[str, list]]]) -> list[pa.RecordBatch]:
    """The rows of the pages as one batch, or several if there is but one page.
    Where that fails, page by page: the page that it fails for has its error row."""
    try:
        if len(pages) == 1:
            return _pieces(pages[0][2])
        return [_batch({f.name: [v for _, _, cols in pages for v in cols[f.name]] for f in _ARROW_SCHEMA})]
    except Exception:  # quarantine, never fail the job on one page
        if len(pages) > 1:
            return [b for page in pages for b in _together([page])]
        return [_batch(_error_columns(pages[0][0], pages[0][1], traceback.format_exc(limit=3)))]


def _page_batches(page_id: int, html: str | None, max_nodes: int | None) -> list[pa.RecordBatch]:
    return _together([(page_id, html, _checked(page_id, html, max_nodes))])


def _shred_batches(max_nodes: int | None):
    def run(batches):
        for batch in batches:
            held, rows, size = [], 0, 0
            for pid, html in zip(batch.column("page_id"), batch.column("html")):
                pid, html = pid.as_py(), html.as_py()
                cols = _checked(pid, html, max_nodes)
                n = len(cols["page_id"])
                if held and (rows + n > BATCH_ROWS or size + len(html or "") > BATCH_CHARS):
                    yield from _together(held)
                    held, rows, size = [], 0, 0
                held.append((pid, html, cols))
                rows += n
                size += len(html or "")
            if held:
                yield from _together(held)
    return run


def shred_all(pages: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """pages(page_id, html, ...) -> node rows plus error rows (kind='error',
    the html as their text). Only ``page_id`` and ``html`` cross into Python."""
    src = pages.select(F.col("page_id").cast("long"), F.col("html"))
    return src.mapInArrow(_shred_batches(max_nodes), NODE_SCHEMA)


#: Of the pages that repeat a page_id, the one with the least of these keeps it as its key.
REPEATED = {"least_hash": lambda html: F.xxhash64(html),
            "longest": lambda html: -F.coalesce(F.length(html), F.lit(-1))}
#: Repeated page_ids are broadcast up to this number (a few MB).
BROADCAST_IDS = 500_000
REPEATS = "page_id IS NOT NULL AND pages > 1"
VERSIONS = "page_id long, given_id long, page_hash long"


def page_sizes(pages: DataFrame) -> DataFrame:
    """page_id, the number of pages that have it, and their characters."""
    return materialize(pages.groupBy("page_id").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("html")).alias("chars")))


def page_keys(pages: DataFrame, repeated: str, sizes: DataFrame, n: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """pages(page_id, html) -> (pages with a key of their own as ``page_id``,
    versions, rows set aside: page_id, error, html).

    A page is told by its page_id and its html. Of several pages of one
    page_id one keeps it as key, the others get a hash of both; ``versions``
    (None where no page_id repeats) has the page_id and html hash of each key
    of such pages. Set aside are pages without a page_id, equal copies, and
    pages whose hashed key another page has. Only numbers are shuffled to find
    repeats (``sizes``, ``n`` of them); html is, for pages that do repeat."""
    if repeated not in REPEATED:
        raise ValueError(f"repeated: one of {sorted(REPEATED)}, not {repeated!r}")
    known = pages.where("page_id IS NOT NULL")
    aside = pages.where("page_id IS NULL").select("page_id", F.lit("no page_id").alias("error"), "html")
    again = sizes.where(REPEATS).select(F.col("page_id").alias("again"))
    if not n:
        return known, None, aside
    near = F.broadcast if n <= BROADCAST_IDS else lambda df: df
    rank = F.struct(REPEATED[repeated](F.col("html")).cast("long").alias("r"), F.coalesce(F.md5("html"), F.lit("")).alias("h"))
    repeats = F.col("page_id") == F.col("again")
    forms = materialize(known.join(near(again), repeats, "left_semi").groupBy("page_id", "html")
                        .agg(F.count(F.lit(1)).alias("n")).withColumn("rank", rank))
    first = forms.groupBy(F.col("page_id").alias("again")).agg(F.min("rank").alias("least"))
    forms = forms.join(near(first), repeats).drop("again").withColumn("key", F.when(F.col("rank") == F.col("least"), F.col("page_id"))
                                                        .otherwise(F.xxhash64(F.lit(7), "page_id", "rank.h")))
    hashed = forms.where("key <> page_id").select("key")
    taken = (hashed.groupBy("key").count().where("count > 1").select("key")
             .unionByName(hashed.join(known.select(F.col("page_id").alias("key")), "key", "left_semi")).distinct())
    good = forms.join(taken, "key", "left_anti").unionByName(forms.where("key = page_id").join(taken, "key", "left_semi")
                                                            .select("key", *[c for c in forms.columns if c != "key"]))
    lost = forms.where("key <> page_id").join(taken, "key", "left_semi")
    copies = forms.where("n > 1").select("page_id", "html", F.explode(F.sequence(F.lit(2).cast("long"), "n")).alias("k"))
    aside = (aside.unionByName(copies.select("page_id", F.lit("copy of a page").alias("error"), "html"))
             .unionByName(lost.select("page_id", F.lit("key taken by another page").alias("error"), "html")))
    versions = materialize(good.select(
        F.col("key").alias("page_id"), F.col("page_id").alias("given_id"), F.xxhash64("html").alias("page_hash")))
    pages = (known.join(near(again), repeats, "left_anti")
             .unionByName(good.select(F.col("key").alias("page_id"), "html")))
    return pages, versions, aside


def given_ids(df: DataFrame, versions: DataFrame | None) -> DataFrame:
    """``df`` with keys as the page_ids that were given, and ``version``: the
    html hash of a page whose page_id other pages have, too, else null."""
    if versions is None:
        return df.withColumn("version", F.lit(None).cast("long"))
    v = versions.select("page_id", "given_id", F.col("page_hash").alias("version"))
    out = df.join(v, "page_id", "left").withColumn("page_id", F.coalesce("given_id", "page_id"))
    return out.select(*df.columns, "version")


def shred(pages: DataFrame, repeated: str = "least_hash", max_nodes: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Returns (dom_nodes, quarantine, versions). ``page_id`` of the nodes is the
    page's key (``page_keys``); the quarantine (given page_id, stage, error,
    html) has what was set aside and the pages that failed or have more than
    ``max_nodes`` nodes. Each page is shredded once: nodes and error rows are
    written together and both results read what was written."""
    spark = pages.sparkSession
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), "html")
    sizes = page_sizes(given)
    total = sizes.agg(F.sum("chars").alias("chars"), F.count_if(F.expr(REPEATS)).alias("again")).first()
    keyed, versions, aside = page_keys(given, repeated, sizes, total["again"])
    # one hash partitioning by page_id for the whole DOM pipeline: later
    # windows, aggregates and (page_id, ...) joins reuse it without a shuffle
    # or a sort; its partitions hold as much whatever the size of the input
    nparts = max(spark.sparkContext.defaultParallelism, -(-(total["chars"] or 0) // PART_CHARS))
    raw = materialize(shred_all(keyed, max_nodes).repartition(nparts, "page_id").sortWithinPartitions("page_id", "node_id"),
                      records=BATCH_PAGES)
    nodes = raw.filter(F.col("kind") != "error").drop("error")
    bad = given_ids(raw.filter(F.col("kind") == "error").select("page_id", "error", F.col("text").alias("html")), versions)
    stage = F.lit("shred").alias("stage")
    quarantine = aside.select("page_id", stage, "error", "html").unionByName(bad.select("page_id", stage, "error", "html"))
    return nodes, quarantine, versions
