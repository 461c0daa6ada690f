"""SentencePiece encoding and decoding by a shared-prefix forward search.

A text is cut into marked words (a run of word marks and what follows up to
the next mark); no piece of the model may reach over such a cut. The distinct
words of a batch are sorted, which is a trie laid out in depth-first order:
the forward table of a word keeps the rows of the prefix that it shares with
the word before, and only the rows after it are computed.

The pieces that end at a position come from an automaton over all pieces
(Aho-Corasick), whose state is kept in each row: a character is one step, and
each state has the list of the pieces that end there, longest first.

The forward table depends on the model's kind:

* unigram: row ``i`` has the best score of a segmentation of the first ``i``
  characters and its last piece (Viterbi);
* byte-pair: the merges give each prefix one segmentation, and that of the
  first ``i`` characters is that of some shorter prefix and one more piece.
  Row ``i`` has that last piece: the piece that ends at ``i`` and that the
  merges would not tear from or join with the piece before it. (A sum of
  scores does not give the ids that such a model stands for.)

Characters that no piece covers become byte pieces if the model has them,
otherwise the unknown piece.
"""

from __future__ import annotations

import math
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from turnstile.llm.common import map_batches, read_table, text_bytes

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Distinct words that a task remembers; beyond it those stay that were met
#: again after their first batch, or none if they are too many.
MEMO_WORDS = 500_000
#: Longer words aren't remembered.
MEMO_CHARS = 64
#: Neighbours whose fit a task remembers.
MEMO_PAIRS = 1_000_000
#: Steps of the automaton over failure links that a task remembers.
MEMO_STEPS = 500_000


class Pieces:
    """Tables of a model: pieces, scores and the forward search over them.

    ``table``: (piece, score) by id; ``kind`` "bpe" or "unigram"; ``special``:
    ids that no text gives (control, unknown, byte pieces, unused)."""

    def __init__(self, table: list[tuple[str, float]], kind: str, special: set[int], unknown: int,
                 byte_ids: list[int] | None, dummy_prefix: bool = True) -> None:
        self.kind, self.unknown, self.byte_ids, self.dummy_prefix = kind, unknown, byte_ids, dummy_prefix
        self.table, self.special = table, special
        self.ids = {p: i for i, (p, _) in enumerate(table) if i not in special}
        self.score = [s for _, s in table]
        self.size = [len(p) for p, _ in table]
        self.bytes = self._bytes()
        self._automaton()
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        # characters in no longer piece stand alone, so they part words too
        alone = "".join(c for c in "\n\t\x0b\x0c" if c not in joined)
        cut = f"[{re.escape(alone)}]" if alone else "(?!)"
        rest = f"[^{MARK}{re.escape(alone)}]"
        self.words = re.compile(f"{cut}|{MARK}+{rest}*|{rest}+")
        if any(p[i] != MARK and p[i + 1] == MARK for p in self.ids for i in range(len(p) - 1)):
            self.words = re.compile("(?s).+")  # pieces reach over marks: a text is one word
        self.minimum = min(self.score, default=0.0) - 10.0
        self.fits: dict[int, bool] = {}
        self.made: dict[int, list[tuple[float, str, str]]] = {}

    # -- which pieces end at a position

    def _automaton(self) -> None:
        """``go``: steps of each state by character; ``fail``: the state of
        its longest proper end; ``ends``: (minus length, id) of the pieces that
        end in it, longest first."""
        self.go: list[dict[str, int]] = [{}]
        self.fail, self.ends, self.steps = [0], [()], 0
        for piece, i in self.ids.items():
            state = 0
            for c in piece:
                state = self.go[state].setdefault(c, len(self.go))
                if state == len(self.go):
                    self.go.append({})
                    self.fail.append(0)
                    self.ends.append(())
            if piece:
                self.ends[state] = ((-len(piece), i),)
        level = list(self.go[0].values())
        while level:  # shorter states first: their failure links are known
            below = []
            for state in level:
                self.ends[state] += self.ends[self.fail[state]]
                for c, to in self.go[state].items():
                    back = self.fail[state]
                    while back and c not in self.go[back]:
                        back = self.fail[back]
                    self.fail[to] = self.go[back].get(c, 0)
                    below.append(to)
            level = below

    def _step(self, state: int, c: str) -> int:
        """The step over failure links, remembered while there is room."""
        go, fail, back = self.go, self.fail, state
        while back and c not in go[back]:
            back = fail[back]
        to = go[back].get(c, 0)
        if self.steps < MEMO_STEPS:
            self.steps += 1
            go[state][c] = to
        return to

    # -- byte-pair: which neighbours the merges leave alone

    def _merges(self, piece: int) -> list[tuple[float, str, str]]:
        """How the merges make this piece of its own text's characters: always
        the best pair first, the left one of equals. Before each merge its
        score, the first and the last symbol; at the end, minus infinity and
        the piece. Empty if they don't make it."""
        if piece in self.made:
            return self.made[piece]
        ids, score, none, out = self.ids, self.score, -math.inf, []

        def rank(i):
            found = ids.get(symbols[i] + symbols[i + 1])
            return none if found is None else score[found]

        symbols = list(self.table[piece][0])
        ranks = [rank(i) for i in range(len(symbols) - 1)]  # of each symbol with the next one
        while ranks and (best := max(ranks)) > none:
            out.append((best, symbols[0], symbols[-1]))
            at = ranks.index(best)
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(at - 1)
            if at < len(ranks):
                ranks[at] = rank(at)
        out.append((none, symbols[0], symbols[-1]))
        self.made[piece] = out if len(symbols) == 1 else []
        return self.made[piece]

    def _fit(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` stay as they are side by side: at no
        time would the merges rather join the symbol that ends ``left`` with
        the one that begins ``right``. Without a piece on the left (below 0):
        whether the merges make ``right`` of its own text."""
        if len(self.fits) >= MEMO_PAIRS:
            self.fits.clear()
        b = self._merges(right)
        if left < 0:
            ok = bool(b)
        else:
            a = self._merges(left)
            ok, i, j = bool(a and b), 0, 0
            while ok:  # up to a join over the edge either side has its merges as if alone
                (next_a, _, x), (next_b, y, _) = a[i], b[j]
                found = self.ids.get(x + y)
                if found is not None and next_a < self.score[found] >= next_b:
                    ok = False
                elif next_a == next_b == -math.inf:
                    break
                elif next_a >= next_b:
                    i += 1
                else:
                    j += 1
        self.fits[left * len(self.table) + right] = ok
        return ok

    # -- forward tables

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of each word."""
        done, size, flat = self.encode_sorted(words)
        end = np.cumsum(size).tolist()
        return {w: flat[e - n:e] for w, n, e in zip(done, size, end)}

    def encode_sorted(self, words: list[str]) -> tuple[list[str], list[int], list[int]]:
        """The words in sorted order, in which they share their prefixes'
        rows; how many ids each has; all ids side by side."""
        words, size, flat = sorted(words), [], []
        # rows: the automaton's state after the first i characters, their last
        # piece (-1: none, -2: not covered) and, for unigram, the best score
        state, last, total = [0], [-1], [0.0]
        before = ""
        for word in words:
            same = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                same += 1
            del state[same + 1:], last[same + 1:]
            if self.kind == "bpe":
                self._rows_bpe(word[same:], state, last)
            else:
                del total[same + 1:]
                self._rows_unigram(word[same:], state, last, total)
            ids = self._read(word, last)
            size.append(len(ids))
            flat += ids
            before = word
        return words, size, flat

    def _rows_unigram(self, rest: str, state: list[int], last: list[int], total: list[float]) -> None:
        go, ends, score, now = self.go, self.ends, self.score, state[-1]
        for c in rest:
            to = go[now].get(c)
            now = self._step(now, c) if to is None else to
            state.append(now)
            best, piece = total[-1] + self.minimum, -2
            for back, p in reversed(ends[now]):
                if total[back] + score[p] > best:
                    best, piece = total[back] + score[p], p
            last.append(piece)
            total.append(best)

    def _rows_bpe(self, rest: str, state: list[int], last: list[int]) -> None:
        go, ends, fits, many, now = self.go, self.ends, self.fits, len(self.table), state[-1]
        for c in rest:
            to = go[now].get(c)
            now = self._step(now, c) if to is None else to
            state.append(now)
            piece = -2
            for back, p in ends[now]:
                left = last[back]
                ok = fits.get(left * many + p)
                if ok is None:
                    ok = self._fit(left, p)
                if ok:
                    piece = p
                    break
            last.append(piece)

    def _read(self, word: str, last: list[int]) -> list[int]:
        out, i, size = [], len(word), self.size
        while i:
            p = last[i]
            if p >= 0:
                out.append(p)
                i -= size[p]
            else:
                i -= 1
                if self.byte_ids:
                    out.extend(self.byte_ids[b] for b in reversed(word[i].encode()))
                elif not out or out[-1] != self.unknown:  # unknown characters side by side are one piece
                    out.append(self.unknown)
        out.reverse()
        return out

    def marked(self, text: str) -> list[str]:
        """Marked words of a text: spaces as marks, one in front of it all."""
        if not text:
            return []
        text = text.replace(" ", MARK)
        return self.words.findall(MARK + text if self.dummy_prefix else text)

    def decode(self, ids: list[int]) -> str:
        """Pieces side by side, byte pieces as UTF-8 (what isn't, as U+FFFD),
        marks as spaces, without the first mark."""
        data = b"".join(map(self.bytes.__getitem__, ids))
        text = data.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def _bytes(self) -> list[bytes]:
        out = [p.encode() for p, _ in self.table]
        for i in self.special:
            out[i] = b""
        out[self.unknown] = " ⁇ ".encode()
        for b, i in enumerate(self.byte_ids or []):
            out[i] = bytes([b])
        return out


def read_model(path: str = MODEL_PATH, kind: str = "bpe") -> Pieces:
    """``kind``: what the model file's scores mean, "bpe" or "unigram"."""
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    table = [(m.id_to_piece(i), m.get_score(i)) for i in range(n)]
    byte_of = {f"<0x{b:02X}>": b for b in range(256)}
    byte_ids = {byte_of[p]: i for i, (p, _) in enumerate(table) if m.is_byte(i)}
    special = {i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)}
    return Pieces(table, kind, special, m.unk_id(), [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else None)


class Encoder:
    """Texts to ids, with a bounded memory of words. Words that aren't in it
    are encoded together, in sorted order, for each batch.

    ``memo`` numbers the words in the order in which they came; word ``k``
    has ``flat[start[k]:start[k + 1]]``. ``again``: it was met in a later
    batch than its first."""

    def __init__(self, pieces: Pieces, memo_words: int = MEMO_WORDS) -> None:
        self.pieces, self.memo_words = pieces, memo_words
        self._clear()

    def _clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.start, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.again = np.zeros(0, bool)

    def _forget(self) -> None:
        """Only words that were met again stay; next time only those that
        were met once more."""
        kept = np.flatnonzero(self.again)
        words = [w for w, met in zip(self.memo, self.again.tolist()) if met]
        self.flat, self.start = self._ids(kept)
        self.memo = dict(zip(words, range(len(words))))
        self.again = np.zeros(len(words), bool)

    def _add(self, words: list[str], size: list[int], flat: list[int]) -> None:
        known = len(self.memo)
        self.memo.update(zip(words, range(known, known + len(words))))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(size, dtype=np.int64)])
        self.flat = np.concatenate([self.flat, np.array(flat, np.int32)])
        self.again = np.concatenate([self.again, np.zeros(len(words), bool)])

    def _ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words side by side, and where each begins; the
        last begin is the end."""
        size = self.start[at + 1] - self.start[at]
        begin = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.repeat(self.start[at] - begin[:-1], size) + np.arange(begin[-1])], begin

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words, bounds = [], [0]
        for t in texts:
            words += self.pieces.marked(t)
            bounds.append(len(words))
        at, fresh = self._find(words)
        if len(self.memo) + len(fresh) > self.memo_words:
            self._forget()
            at, fresh = self._find(words)
        if len(self.memo) + len(fresh) > self.memo_words:
            self._clear()
            at, fresh = self._find(words)
        self.again[at[at >= 0]] = True
        # long words aren't remembered: they come last and go at the end
        far = [w for w in fresh if len(w) > MEMO_CHARS]
        fresh.difference_update(far)
        self._add(*self.pieces.encode_sorted(list(fresh)))
        stay = len(self.memo)
        self._add(*self.pieces.encode_sorted(far))
        unknown = np.flatnonzero(at < 0)
        at[unknown] = np.fromiter(map(self.memo.__getitem__, map(words.__getitem__, unknown.tolist())), np.int64, len(unknown))
        out = [self._ids(at[a:b])[0] for a, b in zip(bounds, bounds[1:])]
        for w in far:
            del self.memo[w]
        self.start, self.flat, self.again = self.start[:stay + 1], self.flat[:self.start[stay]], self.again[:stay]
        return out

    def _find(self, words: list[str]) -> tuple[np.ndarray, set[str]]:
        """Each word's number, -1 for the unknown ones, and the set of these."""
        at = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
        return at, {words[k] for k in np.flatnonzero(at < 0).tolist()}


def encode(spark: SparkSession, docs: DataFrame, model_path: str = MODEL_PATH, kind: str = "bpe",
           check: bool = False) -> DataFrame:
    """Per document: doc_id, ids (array of int); with ``check`` also
    ``round_trip``: whether decoding the ids gives the text again.

    Null and empty texts have no ids. The model's word mark in a text can't
    be told from a space, so such a text doesn't come back as it was. Every
    row gives a row, whatever its doc_id; other columns are ignored. The
    model file is a fixed input of bounded size, read on the driver and
    broadcast."""
    shared = spark.sparkContext.broadcast(read_model(model_path, kind))

    def start():
        encoder = Encoder(shared.value)

        def work(texts, part):
            # surrogates and the like can't be in valid UTF-8; what is invalid is replaced
            texts = [t.decode("utf-8", "replace") for t in texts]
            ids = encoder.encode(texts)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            out = {"doc_id": part.column("doc_id"),
                   "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))}
            if check:
                out["round_trip"] = [encoder.pieces.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)]
            return out

        return work

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")),
                       f"doc_id long, ids array<int>{', round_trip boolean' if check else ''}", start)


def decode(spark: SparkSession, encoded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """``encoded`` (doc_id, ids) as doc_id, text. Null ids give empty text."""
    shared = spark.sparkContext.broadcast(read_model(model_path))

    def start():
        pieces = shared.value
        return lambda ids, part: {"doc_id": part.column("doc_id"), "text": [pieces.decode(x or []) for x in ids]}

    return map_batches(encoded.select("doc_id", "ids"), "doc_id long, text string", start, column="ids")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode(spark, read_table(spark, sf_dir, "documents"), check=True)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")
