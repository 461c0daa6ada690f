"""Vector codes, word byte-pair pieces and resampling, against brute force and the library."""

import hashlib
import json
import math
import random
import re
from zlib import crc32

import numpy as np
import pytest
import tokenizers
from hypothesis import given, settings, strategies as st

from tests.llm.conftest import ODD, documents
from turnstile.llm import resample, vector_codes, word_bpe

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- vector codes

def brute_codes(rows, width, entries=16, rounds=6):
    """rows: (id, vector, label); by definition, in Python's integers."""
    def whole(x):
        a, b = float(x).as_integer_ratio()
        return a * 4096 // b
    good = [(i, [whole(x) for x in v], l) for i, v, l in rows
            if i is not None and v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    at = vector_codes.bounds(width, 8)
    first = [v for _, v, _ in sorted(good, key=lambda r: (r[0], r[1]))[:entries]]
    books = [[v[a:b] for v in first] for a, b in zip(at, at[1:])]

    def best(p, book):
        far = [sum((x - y) ** 2 for x, y in zip(p, e)) for e in book]
        return far.index(min(far)), min(far)
    for _ in range(rounds):
        for k, (a, b) in enumerate(zip(at, at[1:])):
            own = [[] for _ in books[k]]
            for _, v, _ in good:
                own[best(v[a:b], books[k])[0]].append(v[a:b])
            books[k] = [[sum(c) // len(ps) for c in zip(*ps)] if ps else e for ps, e in zip(own, books[k])]
    out, by_label = [], {}
    for i, v, l in good:
        found = [best(v[a:b], book) for book, a, b in zip(books, at, at[1:])]
        error = sum(d for _, d in found)
        out.append((i, "".join(f"{c:02x}" for c, _ in found), error, l))
        by_label[l] = by_label.get(l, 0) + error
    fits = lambda e: e if e < 2 ** 63 else None
    return sorted(((i, c, fits(e), by_label[l]) for i, c, e, l in out), key=str), [[list(e) for e in b] for b in books]


def vector_rows(spark, rows):
    return spark.createDataFrame([(i, v, l, "own", 1) for i, v, l in rows],
                                 "vec_id long, embedding array<double>, label int, code string, error long")


def coded(spark, rows):
    out, books = vector_codes.compress(spark, vector_rows(spark, rows))
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in out.collect()), key=str), [b.tolist() for b in books]


@pytest.mark.parametrize("width", [16, 11])
def test_vector_codes(spark, width, monkeypatch):
    monkeypatch.setattr(vector_codes, "CHUNK_ROWS", 70)
    rng = np.random.default_rng(width)
    centres = rng.normal(size=(6, width))
    rows = [(int(i), (centres[i % 6] + rng.normal(size=width) * 0.05).tolist(), None if i % 5 == 0 else int(i % 3)) for i in range(400)]
    rows += [(1000 + k, [0.25] * width, 7) for k in range(200)]  # one vector of many
    rows += [(5, rows[5][1], 1), (5, rows[6][1], 2)]             # rows that repeat an id
    rows += [(2000, None, 1), (2001, [], 1), (2002, [1.0] * (width - 1) + [None], 1), (2003, [float("nan")] * width, 1),
             (2004, [float("inf")] * width, 1), (None, [1.0] * width, 1), (2005, [0.0] * width, 1), (2006, [-0.3] * width, None)]
    assert coded(spark, rows) == brute_codes(rows, width)


def test_vector_codes_of_few_and_none(spark):
    rows = [(k, [float(k)] * 8, 1) for k in range(5)]
    assert coded(spark, rows) == brute_codes(rows, 8)
    out, books = vector_codes.compress(spark, vector_rows(spark, rows).limit(0))
    assert out.columns == ["vec_id", "label", "code", "error", "label_error"] and out.collect() == [] and books[0].size == 0
    out, _ = vector_codes.compress(spark, vector_rows(spark, rows).drop("label"))
    assert len({r.label_error for r in out.collect()}) == 1


def test_vector_codes_of_large_components(spark):
    """Squares and sums beyond 64 bits."""
    rng = np.random.default_rng(5)
    rows = [(k, (rng.normal(size=8) * 10.0 ** rng.integers(-3, 30)).tolist(), None) for k in range(60)]
    got, books = coded(spark, rows)
    want, want_books = brute_codes(rows, 8)
    assert books == want_books and [g[:3] for g in got] == [w[:3] for w in want]
    rows = [(k, (rng.normal(size=8) * 300_000).tolist(), 1) for k in range(60)]
    assert coded(spark, rows) == brute_codes(rows, 8)


@pytest.mark.parametrize("limit", [vector_codes.BROADCAST_LABELS, 0])
def test_label_errors(spark, limit, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", limit)
    df = spark.createDataFrame([(k, None if k % 4 == 0 else str(k % 3), "00", k) for k in range(300)],
                               "vec_id long, label string, code string, error long")
    got = {r.vec_id: r.label_error for r in vector_codes.with_label_errors(spark, df).collect()}
    key = lambda k: None if k % 4 == 0 else k % 3
    assert got == {k: sum(j for j in range(300) if key(j) == key(k)) for k in range(300)}


def test_hilbert_order_steps_to_a_neighbour():
    grid = np.array([(x, y) for x in range(256) for y in range(256)])
    grid = np.random.default_rng(1).permutation(grid)
    path = grid[vector_codes.hilbert_order(grid)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
    assert vector_codes.hilbert_order(np.zeros((5, 3), np.int64)).tolist() == [0, 1, 2, 3, 4]


def test_shortlists_lose_no_nearest_entry():
    rng = np.random.default_rng(8)
    points = (rng.normal(size=(4096, 4)) * 300).astype(np.int64)
    entries = points[:16].copy()
    entries[3] = entries[9]  # equal entries: the lower index
    row = vector_codes.chunk_row(list(range(4096)), [None] * 4096, points / 4096, 1)
    part, = vector_codes.parts_of(row, 4, 1)
    code, far = part.assign(entries)
    want = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (code == want.argmin(1)).all() and (far == want.min(1)).all()
    assert part.shortlists(entries).sum(1).mean() < 10
    counts, total = part.sum_up(entries)
    assert counts.tolist() == np.bincount(code, minlength=16).tolist()
    assert all((total[k] == points[code == k].sum(0)).all() for k in range(16))


# -- word byte-pair pieces

@pytest.fixture(scope="module")
def model():
    return word_bpe.read_model()


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(word_bpe.MODEL_PATH)


def ids_of(model, texts, memo_words=word_bpe.MEMO_WORDS, path=word_bpe.MODEL_PATH):
    cutter, memo = word_bpe.Cutter(path, model.parts), {}
    memo |= {s: np.array([i], "<u4").tobytes() for s, i in model.special_marks.items()}
    return [np.frombuffer(p, "<u4").tolist() for p in model.encode_packed(texts, cutter, memo, memo_words)]


TEXTS = ["", " ", "\n\t", "Hello, WORLD's 123 ½ they'll", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext|",
         "ΑΣ ΣΑΣ. İstanbul ẞ ǅ", "é é ẛ̣", "日本語 中文 한국어 ไทย", "a\x00b\x1cc\x85d　e​f", "'s'S 'LL ''t",
         "x" * 5000, "ab" * 3000, "-" * 3000, "\U0001F600\U0001F1E9\U0001F1EA", "the cat " * 300]


def test_words_are_the_librarys(model, library):
    assert ids_of(model, TEXTS) == [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
    for text in TEXTS:
        ids = library.encode(text, add_special_tokens=False).ids
        assert model.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert ids_of(model, TEXTS, memo_words=3) == ids_of(model, TEXTS)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="aenrst ĲΣς'S1é日<|>", max_size=60)), max_size=5))
def test_words_of_batches(model, library, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert ids_of(model, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("long_word", [0, 512])
def test_merges_in_any_order_of_ranks(tmp_path, monkeypatch, long_word):
    """Made-up merges: symbols that several pairs make, and pairs that rank
    before the pair that makes their symbol."""
    monkeypatch.setattr(word_bpe, "LONG_WORD", long_word)
    rng, early = random.Random(3), 0
    own = json.load(open(word_bpe.MODEL_PATH, encoding="utf-8"))
    for trial in range(12):
        letters = word_bpe.byte_letters()
        known = ["a", "b", "c", "a</w>", "b</w>", "c</w>"]
        merges = []
        while len(merges) < 25:
            a, b = rng.choice([k for k in known if not k.endswith("</w>")]), rng.choice(known)
            if (a, b) not in merges and len(a + b) < 14:
                merges.append((a, b))
                known.append(a + b)
        rng.shuffle(merges)
        vocab = {t: k for k, t in enumerate(dict.fromkeys([*letters, *(c + "</w>" for c in letters), *known]))}
        own["model"] |= {"vocab": vocab, "merges": [list(m) for m in merges]}
        own["added_tokens"] = []
        path = tmp_path / f"{trial}.json"
        path.write_text(json.dumps(own))
        toy, lib = word_bpe.read_model(str(path)), tokenizers.Tokenizer.from_file(str(path))
        early += toy.early.sum()
        texts = [" ".join("".join(rng.choices("abc", k=rng.randint(1, 30))) for _ in range(20)) for _ in range(20)]
        assert ids_of(toy, texts, path=str(path)) == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert early > 0


def test_word_bpe_of_a_table(spark, odd, nothing, library):
    docs = odd.withColumnRenamed("n_chars", "ids")
    out = word_bpe.encode(spark, docs, ("n_tokens", "ids", "packed", "decoded"))
    rows = [(r.doc_id, r.ids, r.n_tokens, bytes(r.packed), r.decoded) for r in out.collect()]
    want = []
    for d, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, ids, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert sorted(rows, key=str) == sorted(want, key=str)
    back = word_bpe.decode(spark, out.select("doc_id", "ids"))
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(((w[0], w[4]) for w in want), key=str)
    assert word_bpe.encode(spark, nothing).collect() == []


# -- resampling

def brute_resample(rows, target, max_run=1, buckets=10_000, least=20, percent=10):
    def feats(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
        return len(w), [crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, max_run + 1) for i in range(len(w) - n + 1)]
    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for _, text in rows:
        np.add.at(s, feats(text)[1], 1)
    for text in target:
        np.add.at(t, feats(text)[1], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (int(s.sum()) + buckets) / ((a + 1) * (int(t.sum()) + buckets))))
            for a, b in zip(s.tolist(), t.tolist())]
    out = []
    for d, text in rows:
        n, f = feats(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    may = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(may[:percent * len(may) // 100])}
    return sorted(((*r[:4], drawn.get(id(r))) for r in out), key=str)


@pytest.mark.parametrize(("max_run", "percent"), [(1, 10), (3, 50), (2, 100)])
def test_resample(spark, max_run, percent):
    rng = random.Random(max_run)
    words = [f"w{k}" for k in range(60)] + ["Über", "日本", "a-b", "x"]
    rows = ODD + [(100 + k, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(120)]
    target = ["w1 w2 w3 w1 w2", None, "", "Über w7 w7"]
    docs = documents(spark, rows, "score long,rank long,before long")
    wanted = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    out = resample.resample(spark, docs, wanted, max_run=max_run, percent=percent)
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()), key=str)
    assert got == brute_resample(rows, target, max_run, percent=percent)


def test_resample_of_nothing(spark, nothing):
    wanted = spark.createDataFrame([], "text string")
    assert resample.resample(spark, nothing, wanted).collect() == []
    rows = [(k, "word " * 30) for k in range(20)]
    got = resample.resample(spark, documents(spark, rows), wanted).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=300), st.binary(max_size=300)), min_size=1, max_size=20))
def test_crc_of_runs(pairs):
    left, right = (np.array([crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    got = resample.composed(left, right, np.array([len(b) for _, b in pairs], np.int64))
    assert got.tolist() == [crc32(a + b" " + b) for a, b in pairs]


def test_payloads_are_words_in_order():
    texts = [b"", b"a b a", "ab aé É ab".encode(), b"  x-y_z 9 ", b"a"]
    crc, size, counts = resample.payloads(texts)
    words = [re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    assert crc.tolist() == [crc32(w) for ws in words for w in ws]
    assert size.tolist() == [len(w) for ws in words for w in ws]
