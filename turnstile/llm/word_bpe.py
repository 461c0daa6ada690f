"""Byte-pair encoding with word ends, in batched rounds of merges.

A text is cut at the special tokens, normalised and cut into words as the
tokenizer's file says. The distinct words of a slice of rows that the task
doesn't know yet are encoded together: their symbols lie in one flat array,
each pair's rank is found by binary search over the sorted pair keys, and in
every round each word merges its pair of the lowest rank, wherever the word
holds it. Words that have no pair left leave the array. In words of more than
``LONG_WORD`` symbols a round takes one rank's positions from a queue of
ranks instead of going over all symbols, so time grows with the merges.

Merging every place of a pair at once gives what merging them one by one from
the left does, unless a pair with the symbol just made ranks before the pair
that made it. Vocabularies may hold such ranks; of those only the first
place is merged in a round.

Normalising and cutting are done by Python's own tables. A character that the
tokenizers library treats otherwise (its Unicode tables may be of another
version) is found when it is first seen, and texts that hold one are cut by
the library's normaliser and pre-tokeniser.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from turnstile.llm.common import map_batches, read_table, text_bytes

MODEL_PATH = public_tokenizers.path("word_bpe_49k.json")
#: Words that a task remembers; beyond it the memory starts anew.
MEMO_WORDS = 300_000
#: Longer words aren't remembered.
MEMO_CHARS = 64
#: Words of more symbols are merged by the queue of ranks.
LONG_WORD = 512

NONE = np.iinfo(np.int64).max
#: White space by Unicode, spelled out: Python counts some separators besides.
SPACE = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: How the vocabulary's file cuts words (its suffixes first), as a pattern.
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: bytes
    that print stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordBPE:
    """Tables of a tokenizer's file, and encoding and decoding by them."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str, special: dict[str, int]) -> None:
        self.tokens = [""] * (max([*vocab.values(), *special.values()], default=-1) + 1)
        for token, i in (vocab | special).items():
            self.tokens[i] = token
        self.special = special
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            ranks[vocab[a], vocab[b]] = rank, vocab[a + b]
        found = sorted((a << 32 | b, rank, made) for (a, b), (rank, made) in ranks.items())
        self.keys, self.ranks, self.made = (np.array(c, np.int64) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        least: dict[int, int] = {}
        for (a, b), (rank, _) in ranks.items():
            for x in (a, b):
                least[x] = min(rank, least.get(x, rank))
        #: Ranks whose symbol has a pair that ranks before them.
        self.early = np.zeros(len(merges) + 1, bool)
        for rank, made in ranks.values():
            self.early[rank] = least.get(made, rank) < rank

    # -- merges

    def _found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (``NONE``: no merge) and the symbol it makes."""
        if not len(self.keys):
            return np.full(len(left), NONE), left
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), self.made[at]

    @staticmethod
    def _every_other(hit: np.ndarray) -> np.ndarray:
        """Of hits side by side (which overlap) the first, the third and so on."""
        at = np.flatnonzero(hit)
        run = np.concatenate([[0], np.cumsum(np.diff(at) != 1)])
        begin = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
        return at[(np.arange(len(at)) - begin[run]) % 2 == 0]

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one word's after the other's, and their number in each word."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, data), np.int64, len(data))
        own = np.frombuffer(b"".join(data), np.uint8)
        flat, word, ends = self.inner[own], np.repeat(np.arange(len(words)), size), np.cumsum(size)
        flat[ends - 1] = self.final[own[ends - 1]]
        out, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in np.flatnonzero(size > LONG_WORD):
            out.append(self._merge_long(flat[ends[k] - size[k]:ends[k]]))
            of.append(np.full(len(out[-1]), k))
        short = size[word] <= LONG_WORD
        flat, word = flat[short], word[short]
        while len(flat):
            rank, made = self._found(flat, np.append(flat[1:], 0))
            last = np.append(word[1:] != word[:-1], True)
            rank[last] = NONE  # no pair reaches over a word's end
            begin = np.flatnonzero(np.concatenate([[True], last[:-1]]))
            size = np.diff(np.append(begin, len(flat)))
            lowest = np.minimum.reduceat(rank, begin)
            low = np.repeat(lowest, size)
            done = low == NONE
            out.append(flat[done])
            of.append(word[done])
            hit = (rank == low) & ~done
            early = hit & self.early[np.where(hit, rank, 0)]
            if early.any():  # only the first place of the word
                place = np.where(early, np.arange(len(flat)), len(flat))
                hit &= ~early | (place == np.repeat(np.minimum.reduceat(place, begin), size))
            at = self._every_other(hit)
            flat[at] = made[at]
            stay = ~done
            stay[at + 1] = False
            flat, word = flat[stay], word[stay]
        flat, of = np.concatenate(out), np.concatenate(of)
        return flat[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        n = len(symbols)
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n + 1, bool)
        alive[n] = False
        flat = np.append(symbols, 0)
        places: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def note(at: np.ndarray) -> None:
            """Queue the pairs that begin at ``at``."""
            at = at[(at >= 0)]
            at = at[alive[at] & (after[at] < n)]
            rank, _ = self._found(flat[at], flat[after[at]])
            at, rank = at[rank != NONE], rank[rank != NONE]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for some in np.split(at, cuts) if len(at) else []:
                r = int(self._found(flat[some[:1]], flat[after[some[:1]]])[0][0])
                if r not in places:
                    places[r] = []
                    heapq.heappush(queue, r)
                places[r].append(some)

        note(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[alive[at] & (after[at] < n)]
            rank, made = self._found(flat[at], flat[after[at]])
            at, made = at[rank == r], made[rank == r]
            if not len(at):
                continue
            if self.early[r]:
                keep = np.arange(len(at)) == 0
            else:  # places side by side overlap: every other one
                run = np.concatenate([[0], np.cumsum(after[at[:-1]] != at[1:])])
                begin = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
                keep = (np.arange(len(at)) - begin[run]) % 2 == 0
            rest, at, made = at[~keep], at[keep], made[keep]
            gone = after[at]
            flat[at] = made
            alive[gone] = False
            after[at] = after[gone]
            inside = after[at] < n
            before[after[at][inside]] = at[inside]
            note(np.concatenate([before[at], at, rest]))
        return flat[:n][alive[:n]]

    # -- texts

    def encode_packed(self, texts: list[str], cutter: "Cutter", memo: dict[str, bytes], memo_words: int = MEMO_WORDS) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers. ``memo`` keeps
        words between calls."""
        cut = [cutter.words(t) for t in texts]
        fresh = set().union(*cut) - memo.keys() if cut else set()
        if len(memo) + len(fresh) > memo_words:
            memo.clear()
            memo |= {s: np.array([i], "<u4").tobytes() for s, i in self.special_marks.items()}
            fresh = set().union(*cut) - memo.keys()
        new = list(fresh)
        if new:
            ids, count = self.merge_words(new)
            packed, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(count)).tolist()
            memo |= {w: packed[a:b] for w, a, b in zip(new, [0, *ends], ends)}
        out = [b"".join(map(memo.__getitem__, words)) for words in cut]
        for word in new:
            if len(word) > MEMO_CHARS:
                del memo[word]
        return out

    @property
    def special_marks(self) -> dict[str, int]:
        """Special tokens as the cutter names them: no word holds a space."""
        return {f" {s}": i for s, i in self.special.items()}

    def decode(self, ids: list[int]) -> str:
        """The tokens side by side with a space between, as the file names no decoder."""
        return " ".join([self.tokens[i] for i in ids])


class Cutter:
    """Cuts texts into words, special tokens as words that begin with a space."""

    def __init__(self, path: str, special: regex.Pattern | None) -> None:
        own = tokenizers.Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = own.normalizer, own.pre_tokenizer
        self.special = special
        letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.seen, self.odd = set(map(chr, range(128))), set()

    @staticmethod
    def _plain(text: str) -> list[str]:
        # lower case is taken letter by letter: no final sigma
        return WORD.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _by_library(self, text: str) -> list[str]:
        pieces = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, p)).decode() for p, _ in pieces]

    def _odd(self, text: str) -> bool:
        for c in set(text) - self.seen:
            self.seen.add(c)
            if any(self._plain(t) != self._by_library(t) for t in (f"a{c}a", f"1{c}{c}1", f"!{c}!")):
                self.odd.add(c)
        return bool(self.odd) and not self.odd.isdisjoint(text)

    def _words(self, text: str) -> list[str]:
        return self._by_library(text) if not text.isascii() and self._odd(text) else self._plain(text)

    def words(self, text: str) -> list[str]:
        if self.special is None or self.special.search(text) is None:
            return self._words(text)
        out = []
        for k, part in enumerate(self.special.split(text)):
            out += [f" {part}"] if k % 2 else self._words(part)
        return out


def read_model(path: str = MODEL_PATH) -> WordBPE:
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    model = own["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return WordBPE(model["vocab"], merges, model.get("end_of_word_suffix") or "",
                   {t["content"]: t["id"] for t in own.get("added_tokens", []) if t["special"]})


COLUMNS = {"n_tokens": "long", "ids": "array<int>", "packed": "binary", "decoded": "string"}


def encode(spark: SparkSession, docs: DataFrame, columns: tuple[str, ...] = ("ids",), model_path: str = MODEL_PATH,
           id_column: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id and of ``COLUMNS`` those asked for (the
    number of ids, the ids, the ids as little-endian 32-bit integers, what
    they decode to).

    Null and empty texts have no ids and decode to an empty text; texts of
    any length are encoded whole. Every row gives a row, whatever its id; an
    empty table gives none; other columns are ignored. The tokenizer's file,
    a fixed input, must be at its path on the executors as well."""
    shared = spark.sparkContext.broadcast(read_model(model_path))

    def start():
        model = shared.value
        cutter, memo = Cutter(model_path, model.parts), {}
        memo |= {s: np.array([i], "<u4").tobytes() for s, i in model.special_marks.items()}

        def work(texts, part):
            packed = model.encode_packed([t.decode("utf-8", "replace") for t in texts], cutter, memo)
            ids = [np.frombuffer(p, "<u4") for p in packed]
            out = {"doc_id": part.column("doc_id"), "n_tokens": [len(i) for i in ids], "packed": packed}
            if "ids" in columns:
                ends = np.cumsum([0] + [len(i) for i in ids]).astype(np.int32)
                out["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
            if "decoded" in columns:
                out["decoded"] = [model.decode(i.tolist()) for i in ids]
            return out

        return work

    return map_batches(docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), text_bytes().alias("text")),
                       ", ".join(["doc_id long", *(f"{c} {COLUMNS[c]}" for c in columns)]), start)


def decode(spark: SparkSession, encoded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """``encoded`` (doc_id, ids) as doc_id, text. Null ids give an empty text."""
    shared = spark.sparkContext.broadcast(read_model(model_path))

    def start():
        model = shared.value
        return lambda ids, part: {"doc_id": part.column("doc_id"), "text": [model.decode(x or []) for x in ids]}

    return map_batches(encoded.select("doc_id", "ids"), "doc_id long, text string", start, column="ids")


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(spark, read_table(spark, sf_dir, "documents"), ("n_tokens", "packed", "decoded"))
    return out.select("doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
