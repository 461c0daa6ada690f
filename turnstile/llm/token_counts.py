"""Token counts by greedy longest match, without building the pieces.

The vocabulary is a trie with failure links: from a node that has no child
for the next byte, the link goes to the node that is left after the longest
pieces that can be cut from the front have been cut, and the link's number
says how many those were. One pass over a word's bytes then gives the number
of its pieces in time linear in the word.

A word is a run without ASCII white space. Its first piece is looked up with
the vocabulary's word mark (a leading space here) and the following pieces
without. Where no piece of the mark and the word's first bytes exists, the
mark alone is the first piece if the vocabulary has it. A word that can't be
cut whole into pieces counts as one unknown piece.
"""

from __future__ import annotations

import base64
from collections import deque

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnstile.llm.common import map_batches, read_table, text_bytes

VOCAB_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MARK = b" "
#: Words whose counts a task remembers; beyond it the memory starts anew.
MEMO_WORDS = 300_000


def read_vocab(path: str = VOCAB_PATH) -> list[bytes]:
    """Pieces of a rank file (base64 piece and rank on each line)."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class LongestMatch:
    """Trie of both kinds of pieces with failure links and cut counts.

    State 0 is the root of first pieces, state 1 that of following pieces.
    With ``alone``, a piece that is the mark alone leads from state 0 to
    state 1; without it, such a piece is left out.
    ``count(word)``: number of greedy longest-match pieces."""

    def __init__(self, pieces: list[bytes], mark: bytes = MARK, alone: bool = False) -> None:
        self.next: dict[int, int] = {}
        self.ends = bytearray(2)
        parent, label = [0, 0], [0, 0]
        found_alone = False
        for piece in pieces:
            first = piece.startswith(mark)
            body = piece[len(mark):] if first else piece
            if not body:
                found_alone |= first
                continue
            node = 0 if first else 1
            for byte in body:
                key = node << 8 | byte
                found = self.next.get(key)
                if found is None:
                    found = self.next[key] = len(parent)
                    parent.append(node)
                    label.append(byte)
                    self.ends.append(0)
                node = found
            self.ends[node] = 1
        n = len(parent)
        self.fail, self.cut = [-1] * n, [0] * n
        if alone and found_alone:
            self.fail[0], self.cut[0] = 1, 1
        children: dict[int, list[int]] = {}
        for node in range(2, n):
            children.setdefault(parent[node], []).append(node)
        queue = deque(children.get(0, []) + children.get(1, []))
        while queue:
            node = queue.popleft()
            queue.extend(children.get(node, []))
            if self.ends[node]:
                self.fail[node], self.cut[node] = 1, 1
                continue
            # as the parent's link would go on with this byte
            at, cut = self.fail[parent[node]], self.cut[parent[node]]
            while at != -1 and (found := self.next.get(at << 8 | label[node])) is None:
                cut, at = cut + self.cut[at], self.fail[at]
            if at != -1:
                self.fail[node], self.cut[node] = found, cut

    def count(self, word: bytes) -> int:
        step, fail, cut = self.next, self.fail, self.cut
        node = n = 0
        for byte in word:
            while (found := step.get(node << 8 | byte)) is None:
                n += cut[node]
                node = fail[node]
                if node == -1:
                    return 1
            node = found
        while node != 1:  # cut what is left
            n += cut[node]
            node = fail[node]
            if node == -1:
                return 1
        return n


class Memo(dict):
    """Counts of words seen; computes what is missing."""

    def __init__(self, automaton: LongestMatch, words: int = MEMO_WORDS) -> None:
        super().__init__()
        self.automaton, self.words = automaton, words

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.words:
            self.clear()
        n = self.automaton.count(word)
        if len(word) <= 64:
            self[word] = n
        return n


def token_counts(spark: SparkSession, docs: DataFrame, vocab_path: str = VOCAB_PATH,
                 mark: bytes = MARK) -> DataFrame:
    """Per document: doc_id, n_words, n_tokens. One narrow pass, no shuffle.

    Null, empty and blank texts have no words and no tokens. Every row gives
    a row, repeated or null ids too; other columns are ignored. The
    vocabulary file is a fixed input of bounded size; it is read on the
    driver and its pieces are broadcast, each task builds the automaton."""
    pieces = spark.sparkContext.broadcast(read_vocab(vocab_path))

    def start():
        memo = Memo(LongestMatch(pieces.value, mark, alone=True))

        def work(texts, part):
            words = list(map(bytes.split, texts))
            return {"doc_id": part.column("doc_id"), "n_words": list(map(len, words)),
                    "n_tokens": [sum(map(memo.__getitem__, w)) for w in words]}

        return work

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")),
                       "doc_id long, n_words long, n_tokens long", start)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, read_table(spark, sf_dir, "documents"))
