"""Benchmark decontamination with a generalised suffix automaton.

The normalised items of a benchmark go into one suffix automaton over words.
A document's words are streamed through it; the automaton keeps the longest
suffix read so far that occurs in some item, so a word position where that
length reaches the window size ends an occurrence of an item's window. Words
inside such occurrences are hit. Items shorter than a window count as one
window of their own length.

Everything is dealt out. Tasks cut items into pieces (a long item into
several that overlap by a window less a word), deal them into shards by hash
and build the automata, each of at most ``SHARD_WORDS`` words, into a table in
the shared checkpoint folder. Documents then pass through ``PASS_SHARDS``
automata at a time, which are broadcast: driver and workers hold that many,
however large the benchmark. One pass (benchmarks of up to 800,000 words) is
a narrow job without a shuffle; of several, each writes the spans it found,
which are merged by document afterwards, so documents are read once a pass.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnstile.session import ensure_checkpoint_dir
from turnstile.llm.common import WORDS, boxed, map_batches, read_table, text_bytes, unboxed

WINDOW = 10
#: Words of an automaton at most, and of a piece of an item at most.
SHARD_WORDS = 200_000
PIECE_WORDS = 20_000
#: Automata that a worker holds at a time.
PASS_SHARDS = 4
#: A document that loses more than this share of its words goes as a whole.
MAX_COVERAGE = 0.5

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Automaton:
    """Generalised suffix automaton of word sequences.

    ``items``: (id, words) pairs; the id may be None (its windows hit, but
    no item is named). ``scan(words)`` gives the hit spans and the items."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        coded = [(i, [self.vocab.setdefault(w, len(self.vocab)) for w in words])
                 for i, words in items if words]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.least = min([window, *(len(w) for _, w in coded)])
        self._cut()
        #: state of a window -> items that have it; state of a whole short item -> those items
        self.owners: dict[int, set] = {}
        self.short: dict[int, set] = {}
        for i, words in coded:
            state = 0
            for at, w in enumerate(words):
                state = self.step[state][w]
                if at + 1 >= window:
                    self.owners.setdefault(self.at_window[state], set()).add(i)
            if len(words) < window:
                self.short.setdefault(state, set()).add(i)
        self._shortest()

    def _extend(self, last: int, w: int) -> int:
        step, link, size = self.step, self.link, self.size
        if w in step[last]:
            found = step[last][w]
            return found if size[found] == size[last] + 1 else self._clone(last, w, found)
        new = len(size)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p != -1 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p != -1:
            q = step[p][w]
            link[new] = q if size[q] == size[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        new = len(self.size)
        self.step.append(dict(self.step[q]))
        self.link.append(self.link[q])
        self.size.append(self.size[p] + 1)
        self.link[q] = new
        while p != -1 and self.step[p].get(w) == q:
            self.step[p][w] = new
            p = self.link[p]
        return new

    def _cut(self) -> None:
        """For each state of at least a window: the suffix state that holds its last ``window`` words."""
        self.at_window = list(range(len(self.size)))
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            if self.size[self.link[s]] >= self.window:
                self.at_window[s] = self.at_window[self.link[s]]

    def _shortest(self) -> None:
        """For each state: the nearest suffix state (or itself) that is a whole short item."""
        self.near = [-1] * len(self.size)
        if self.short:
            for s in sorted(range(len(self.size)), key=self.size.__getitem__):
                self.near[s] = s if s in self.short else self.near[self.link[s]] if s else -1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans [start, end) of hit words, merged and in order, and the ids of the items hit."""
        code = list(map(self.vocab.get, words))
        found: list[tuple[int, int]] = []
        items: set = set()
        step, link, size, window, near = self.step, self.link, self.size, self.window, self.near
        at, n = 0, len(code)
        while at < n:
            if code[at] is None:
                at += 1
                continue
            end = at
            while end < n and code[end] is not None:
                end += 1
            if end - at >= self.least:  # a shorter run of known words holds no window
                state = length = 0
                for i in range(at, end):
                    w = code[i]
                    while state and w not in step[state]:
                        state = link[state]
                        length = size[state]
                    if w in step[state]:
                        state = step[state][w]
                        length += 1
                    if length >= window:
                        found.append((i + 1 - window, i + 1))
                        items |= self.owners[self.at_window[state]]
                    s = near[state]
                    while s > 0 and size[s] > length:
                        s = near[link[s]]
                    while s > 0:
                        found.append((i + 1 - size[s], i + 1))
                        items |= self.short[s]
                        s = near[link[s]]
            at = end
        return merged(found), items - {None}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def pieces(words: list[bytes], window: int, most: int) -> Iterator[list[bytes]]:
    """``words`` in pieces of at most ``most`` words (but a window at least)
    that hold each window once or twice; fewer than a window stay whole."""
    most = max(most, window)
    if len(words) <= most:
        yield words
        return
    for at in range(0, len(words) - window + 1, most - window + 1):
        yield words[at:at + most]


def build(items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Automata over ``items`` (item_id, text), pickled, one a row: shard,
    automaton. Tasks build them, a shard each; a shard that got more than
    ``shard_words`` words gives several."""
    sized = items.select(F.col("item_id"), text_bytes().alias("text"))
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a word takes two bytes at least, with what parts it from the next
    n = max(1, -(-total // (2 * shard_words)))
    most = min(PIECE_WORDS, shard_words)
    kind = items.schema["item_id"].dataType.simpleString()
    named = pa.schema([("shard", pa.int64()), ("automaton", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cuts = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                words = text.translate(WORDS).split()
                for p in pieces(words, window, most) if words else ():
                    at.append(k)
                    cuts.append(b" ".join(p))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(at, pa.int64())),
                                              pa.array(cuts, pa.binary())], ["item_id", "words"])

    def automata(key: tuple, table: pa.Table) -> pa.Table:
        out, rows, held = [], [], 0
        for i, text in zip(table.column("item_id").to_pylist(), table.column("words")):
            words = text.as_py().split()
            if rows and held + len(words) > max(shard_words, window):
                out.append(pickle.dumps(Automaton(rows, window), 5))
                rows, held = [], 0
            rows.append((i, words))
            held += len(words)
        out.append(pickle.dumps(Automaton(rows, window), 5))
        return pa.table([pa.array([key[0].as_py()] * len(out), pa.int64()), pa.array(out, pa.binary())], schema=named)

    return (sized.mapInArrow(cut, f"item_id {kind}, words binary").distinct()
            .withColumn("shard", F.pmod(F.xxhash64("item_id", "words"), F.lit(n)))
            .groupBy("shard").applyInArrow(automata, "shard long, automaton binary"))


def passes(spark: SparkSession, items: DataFrame, window: int, shard_words: int,
           pass_shards: int) -> tuple[int, Iterator[list[Broadcast]]]:
    """Number of passes, and the broadcast automata of each in turn. They are
    built once; what a pass asks for is all the driver reads."""
    base = f"{ensure_checkpoint_dir(spark)}/automata-{uuid.uuid4().hex}"
    build(items, window, shard_words).write.parquet(base)
    table = spark.read.schema("shard long, automaton binary").parquet(base)
    counts = sorted((r.shard, r["count"]) for r in table.groupBy("shard").count().toLocalIterator())
    # whole shards a pass: two of three automata each would go over four
    groups: list[list[int]] = []
    held = pass_shards
    for shard, n in counts:
        if held + n > pass_shards:
            groups.append([])
            held = 0
        groups[-1].append(shard)
        held += n

    def each() -> Iterator[list[Broadcast]]:
        for g in groups:
            rows = table.where(F.col("shard").isin(g)).select("automaton").toLocalIterator()
            yield [spark.sparkContext.broadcast(bytes(r.automaton)) for r in rows]

    return len(groups), each()


def _key(doc_id: Column) -> Column:
    """What a row's spans depend on; with the id, so that copies of a text spread."""
    return F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"), F.lit(bytearray(b"\0")),
                           text_bytes()), 256)


HITS = "spans array<struct<start:int,end:int>>, item_ids array<string>"


def _through(docs: DataFrame, automata: list[Broadcast], beside: dict[str, str]) -> DataFrame:
    """``docs`` (text and ``beside``, columns and types that pass through),
    each row with n_words and the spans and items that ``automata`` find."""

    def start():
        ready = [pickle.loads(a.value) for a in automata]

        def work(texts, part):
            n, spans, ids = [], [], []
            for t in texts:
                words = t.translate(WORDS).split()
                hit, own = [], set()
                for a in ready:
                    s, i = a.scan(words)
                    hit += s
                    own |= i
                n.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in merged(hit)])
                ids.append(sorted(map(str, own)))
            return {c: part.column(c) for c in beside} | {"n_words": n, "spans": spans, "item_ids": ids}

        return work

    own = "".join(f"{c} {kind}, " for c, kind in beside.items())
    return map_batches(docs, f"{own}n_words long, {HITS}", start)


def _hits(spark: SparkSession, docs: DataFrame, turns: Iterator[list[Broadcast]]) -> DataFrame:
    """Of ``docs`` (key, text) the keys with hits: key, spans, item_ids. Each
    pass leaves what it found in the shared folder, once for each key."""
    base = f"{ensure_checkpoint_dir(spark)}/hits-{uuid.uuid4().hex}"
    for k, automata in enumerate(turns):
        found = _through(docs, automata, {"key": "string"}).where(F.size("spans") > 0)
        (found.groupBy("key").agg(F.first("spans").alias("spans"), F.first("item_ids").alias("item_ids"))
         .write.parquet(f"{base}/turn={k}"))
        for a in automata:
            a.destroy()
    return (spark.read.schema(f"key string, {HITS}").option("recursiveFileLookup", "true").parquet(base).groupBy("key")
            .agg(F.flatten(F.collect_list("spans")).alias("spans"),
                 F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids")))


def _given(spans: list[dict] | None) -> list[tuple[int, int]]:
    return merged([(s["start"], s["end"]) for s in spans or ()])


def scan(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW,
         shard_words: int = SHARD_WORDS, pass_shards: int = PASS_SHARDS) -> DataFrame:
    """Per document: doc_id, n_words, spans (of hit words, [start, end)),
    item_ids (those hit, as strings, sorted).

    Null text has no words. Null or empty items hit nothing; a null item_id
    hits but isn't listed; rows that repeat an item_id are one item. Each row
    of documents gives a row, whatever its doc_id. Empty tables give no rows
    and no hits. Other columns of either table are ignored. A very long text
    is read whole, as one value of a worker; a very long item is cut."""
    n, turns = passes(spark, items, window, shard_words, pass_shards)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    if n < 2:
        return _through(own, next(turns, []), {"doc_id": "long"})
    keyed = own.withColumn("key", _key(F.col("doc_id")))

    def start():
        def work(texts, part):
            return {"doc_id": part.column("doc_id"), "n_words": [len(t.translate(WORDS).split()) for t in texts],
                    "spans": [[{"start": a, "end": b} for a, b in _given(g)] for g in part.column("spans").to_pylist()],
                    "item_ids": [i or [] for i in part.column("item_ids").to_pylist()]}

        return work

    return map_batches(keyed.join(_hits(spark, keyed.select("key", "text"), turns), "key", "left"),
                       f"doc_id long, n_words long, {HITS}", start)


def remove(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW,
           max_coverage: float = MAX_COVERAGE, shard_words: int = SHARD_WORDS,
           pass_shards: int = PASS_SHARDS) -> DataFrame:
    """``docs`` without the hit spans; documents of which more than
    ``max_coverage`` of the words are hit go. Text outside the spans stays
    as it is; a document without a hit is unchanged (null text too). Other
    columns pass through, but ``n_chars`` becomes the length of the new text."""
    n, turns = passes(spark, items, window, shard_words, pass_shards)
    automata = next(turns, []) if n < 2 else []

    def start():
        ready = [pickle.loads(a.value) for a in automata]

        def work(texts, part):
            out, coverage = [], []
            given = part.column("spans").to_pylist() if n > 1 else [None] * len(texts)
            for t, spans in zip(texts, given):
                words = t.translate(WORDS).split() if t else []
                hit = _given(spans) if n > 1 else merged([s for a in ready for s in a.scan(words)[0]])
                lost = sum(b - a for a, b in hit)
                coverage.append(lost / len(words) if words else 0.0)
                if hit:
                    at = [(m.start(), m.end()) for m in WORD.finditer(t.translate(WORDS))]
                    keep, last = [], 0
                    for a, b in hit:
                        keep.append(t[last:at[a][0]])
                        last = at[b - 1][1]
                    t = b"".join(keep) + t[last:]
                out.append(t)
            return {"text": [x.decode("utf-8", "replace") if x is not None else None for x in out],
                    "coverage": coverage, "row": part.column("row")}

        return work

    rest = docs.drop("text")
    box = boxed(rest).schema["row"].dataType.simpleString() if rest.columns else "struct<none:int>"
    own = docs.select(F.col("text").cast("binary").alias("text"),
                      (F.struct(*[F.col(f"`{c}`") for c in rest.columns]) if rest.columns
                       else F.struct(F.lit(0).alias("none"))).alias("row"))
    if n > 1:
        at = F.col("row").getField("doc_id") if "doc_id" in rest.columns else F.lit(None)
        own = own.withColumn("key", _key(at))
        own = own.join(_hits(spark, own.select("key", text_bytes().alias("text")), turns), "key", "left")
    done = map_batches(own, f"text string, coverage double, row {box}", start).where(F.col("coverage") <= max_coverage)
    made = {"text": F.col("text")} | ({"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {})
    return unboxed(done, docs.columns, **made)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
