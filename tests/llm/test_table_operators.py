"""Operators that bring rows together, against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD, documents
from turnstile.llm import line_dedup, near_dup, neighbours, url_filter

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- urls

def brute_verdict(url, listed):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(UPPER), m[2]) if m else ("", "")
    fits = [(len(r), r, v) for v, r in url_filter.RULES
            if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0]))
            and path.startswith("/" + r.partition("/")[2])]
    rule, verdict = max(fits)[1:] if fits else (None, None)
    canon = re.sub(r"^www\.", "", host) + re.sub(r"/+$", "", path) if host else None
    return host, path, rule, verdict or ("block" if canon in listed else "allow")


URLS = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Bad.Org/x/?q#f", "http://bad.org/x", "http://bad.org/x//", "http://bad.org/y",
        "http://a.example.net/en/1", "http://example.net/en", "http://x.net/en/", "http://notexample.net/en/", "http://net/", "http://net",
        "https://example.com/de/", "https://sub.example.com/de/#://y", "https://example.com/fr/", "http://org/fr/x", "http://a.org/fr/x?u=://z",
        "http://bad.org?x=/x", "http://É.org/fr/", "http://bad.org/x", "ftp://bad.org/x\n/z"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "own", "own", 1) for i, u in enumerate(URLS)],
                                  "page_id long, url string, host string, rule string, block long")
    blocked = spark.createDataFrame([("http://bad.org/x/",), ("https://www.bad.org/x",), (None,), ("nothing",)], "url string")
    out = url_filter.url_filter(pages, blocked)
    assert out.columns[:5] == pages.columns
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got == {i: brute_verdict(u, {"bad.org/x"}) for i, u in enumerate(URLS)}
    nothing = url_filter.url_filter(pages, blocked.limit(0))
    assert {r.verdict for r in nothing.where("rule IS NULL").collect()} == {"allow"}
    assert url_filter.url_filter(pages.limit(0), blocked).collect() == []


@pytest.mark.parametrize("limit", [url_filter.BROADCAST_BYTES, 0])
def test_bloom_has_no_false_negative_and_few_false_positives(spark, limit, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", limit)
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    rows = spark.range(9000).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    sifted = url_filter.possible(rows, "key", url_filter.bloom_filter(keys, 3000), 3000).cache()
    assert sifted.where("id < 3000 AND NOT _possible").count() == 0
    assert sifted.where("id >= 3000 AND _possible").count() < 60
    assert url_filter.listed(rows, "key", keys).where("listed").count() == 3000
    sifted.unpersist()


# -- lines

def brute_lines(rows, min_chars=20, min_docs=3):
    def key(x):
        return x.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    split = [(d, (t or "").split("\n")) for d, t in rows]
    seen = {}
    for n, (_, lines) in enumerate(split):
        for k in {key(x) for x in lines}:
            if len(k) >= min_chars:
                seen.setdefault(k, []).append(n)
    out = []
    for d, lines in split:
        keep = []
        for x in lines:
            own = seen.get(key(x), [])
            known = [split[n][0] for n in own if split[n][0] is not None]
            last = max(known) if known else None
            if len(own) < min_docs or d == last:
                keep.append(x)
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def test_lines(spark, nothing):
    rng = random.Random(1)
    lines = ["A line that is long enough to count", "  a LINE that is long enough to COUNT\t", "short", "", "nineteen characters",
             "É line that is long enough to count", "é line that is long enough to count", "\x0bÜber zwanzig Zeichen lang\r", "x" * 20, "own"]
    rows = ODD + [(100 + k if k % 7 else None, "\n".join(rng.choices(lines, k=rng.randint(1, 9))) + f"\nown {k}") for k in range(40)]
    rows += [(99, "\n".join(lines)), (99, "\n".join(lines)), (200, "A line that is long enough to count\n" * 500)]
    docs = documents(spark, rows, "kept string,_doc long,_drop string,row string,t long,id long")
    out = line_dedup.line_dedup(docs)
    assert out.columns[:5] == docs.columns[:5]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in out.collect()), key=str) == brute_lines(rows)
    assert line_dedup.line_dedup(nothing).collect() == []


# -- near duplicates

def brute_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i in range(len(rows)):
        ids.setdefault(find(i), []).append(rows[i][0])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((rows[i][0], len(sets[i]), low[find(i)], rows[i][0] == low[find(i)]) for i in range(len(rows))), key=str)


def near_rows():
    rng = random.Random(4)
    rows, d = [], 1000
    for _ in range(4):
        base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
        for _ in range(9):  # a chain: each a bit further from the first
            rows.append((d, " ".join(base)))
            d -= 7
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(120)] = f"v{rng.randint(0, 10 ** 6)}"
    hub = [f"h{k}" for k in range(200)]
    for k in range(40):  # near copies of one text that are not near to each other
        own = list(hub)
        for i in range(3):
            own[(k * 5 + i * 67) % 200] = f"c{k}-{i}"
        rows.append((2000 + k, " ".join(own)))
    rows.append((1999, " ".join(hub)))
    return rows + [(3000 + k, "the same text for all of them") for k in range(30)]


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_dup(spark, n, percent, nothing):
    rows = [r for r in ODD if r[0] != 5] + near_rows()
    docs = documents(spark, rows, "class string,node long,signature string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_dup(spark, docs, n, percent).collect()), key=str)
    want = brute_components(rows, n, percent)
    # rows of one id without shingles each stand for themselves; so does a null id
    assert got == want
    assert near_dup.near_dup(spark, nothing).collect() == []


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_NODES", 3)
    monkeypatch.setattr(near_dup, "GROUP_SHINGLES", 500)
    rows = near_rows()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept)
                  for r in near_dup.near_dup(spark, documents(spark, rows), 3, 85).collect()), key=str)
    assert got == brute_components(rows, 3, 85)


def test_one_of_each_stays(spark):
    rows = ODD + [(3000 + k, "the same text for all of them") for k in range(5)] + [(3000, "the same text for all of them")]
    docs = documents(spark, rows, "row string,id long,hash long")
    out = near_dup.without_copies(spark, docs)
    assert out.columns == docs.columns
    left = [(r.doc_id, (r.text or "")[:20]) for r in out.collect()]
    assert [x for x in left if x[0] and x[0] >= 3000] == [(3000, "the same text for al")]
    assert sorted(x[0] for x in left if x[0] == 4) == [4, 4]       # two texts of one id
    assert left.count((None, "one two three four f")) == 0       # linked with row 4, which has an id


def test_signature_chunks():
    assert near_dup.chunks_for(85) < near_dup.chunks_for(80) < near_dup.chunks_for(70)
    mul, add = near_dup.multipliers(4000)
    a = near_dup.shingle_hashes(" ".join(f"w{i}" for i in range(1000)).encode(), 1)
    b = near_dup.shingle_hashes(" ".join(f"w{i}" for i in range(100, 1100)).encode(), 1)
    same = (near_dup.signature(a, mul, add) == near_dup.signature(b, mul, add)).mean()
    assert abs(same - 900 / 1100) < 0.03


# -- neighbours

def brute_neighbours(rows, step=20, nearest=20):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None for x in v)]
    good = [(i, v) for i, v in good if np.isfinite(v).all() and v.any() and len(v) == 4]
    good = list({(i, tuple(v)): (i, v) for i, v in good}.values())
    out = {}
    for i, q in good:
        if i % step == 0:
            out[i] = sorted((-(v * q).sum(), j) for j, v in good if j != i)[:nearest]
    return out


def test_neighbours_exact_where_all_is_searched(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4) * rng.uniform(0.5, 2)]) for i in range(400)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(400, 640)]  # one vector of many
    rows += [(700, None), (701, []), (702, [0.0] * 4), (703, [1.0, None, 0.0, 0.0]), (704, [float("nan")] * 4),
             (720, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (740, [1.0] * 3), (20, rows[20][1])]
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], "vec_id long, embedding array<double>, a long, score int")
    got = {}
    for r in neighbours.neighbours(spark, df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_neighbours(rows)
    assert got.keys() == want.keys()
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 21))
        assert [x[1] for x in found] == [j for _, j in want[q]]
        assert np.allclose([x[2] for x in found], [-s for s, _ in want[q]], rtol=1e-12)
    assert neighbours.neighbours(spark, df.limit(0)).collect() == []
    assert neighbours.neighbours(spark, df.where("vec_id IN (20, 21)")).count() == 1


def test_neighbours_ties_of_distinct_vectors(spark):
    rows = [(i, [1.0, float(k % 7), float(k // 7), 0.0]) for i, k in enumerate(np.random.default_rng(3).permutation(300))]
    rows += [(1000, [3.0, 0.0, 0.0, 0.0])]  # one score with each of 300 vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.rank, r.vec_id) for r in neighbours.neighbours(spark, df).where("query_id = 1000").collect())
    assert got == [(k + 1, j) for k, (_, j) in enumerate(brute_neighbours(rows)[1000])]
    assert [j for _, j in got] == list(range(20))


def test_forest_recall(spark, monkeypatch):
    """Many leaves, chunks, groups and query blocks; recall against brute force."""
    for name, value in (("LEAF_ROWS", 32), ("CANDIDATES", 300), ("CHUNK_ROWS", 16), ("GROUP_ROWS", 512), ("QUERY_ROWS", 40)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(3)
    low = rng.normal(size=(2000, 5)) @ rng.normal(size=(5, 16))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(low)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.neighbours(spark, df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, found in got.items():
        s = (low * low[q]).sum(1)
        s[q] = -np.inf
        hits += len(found & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 100 and hits / 2000 >= 0.9
