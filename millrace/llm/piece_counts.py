"""Greedy word-piece lengths by a linear longest-match automaton.

A word, led by a blank, is cut from the left into the longest pieces of a vocabulary.
The automaton is the vocabulary's trie with, for each node, a failure link and the
number of pieces that following it closes. Each byte of a word is read once and no
piece is built; links are followed at most once for each byte read.

Construction: a node that is a piece closes one piece and fails to the root. Any other
node fails as its parent does, on through failure links until the byte can be read;
the pieces closed on the way add up. Every single byte must be in the vocabulary, so
reading never gets stuck.

Defined results: a null or empty text has no words and no pieces; words are parted by
U+0020 and U+0009 to U+000D; repeated rows count each for itself; whole texts count, however
long; a null id is kept; no rows give no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose counts each Python worker keeps, and the longest word kept.
MAX_WORDS, MAX_WORD_BYTES = 1_000_000, 64


class Automaton:
    def __init__(self, vocabulary: Iterable[bytes]):
        children: dict[int, int] = {}
        piece, size, links = bytearray(1), 1, [(0, 0)]
        for token in vocabulary:
            node = 0
            for b in token:
                key = node << 8 | b
                if key not in children:
                    children[key] = size
                    links.append((node, b))
                    piece.append(0)
                    size += 1
                node = children[key]
            piece[node] = 1
        if missing := [b for b in range(256) if b not in children or not piece[children[b]]]:
            raise ValueError(f"the vocabulary lacks the single bytes {missing[:5]}")
        self.children = children
        self.fail, self.closed = [0] * size, [0] * size
        by_node: list[list[int]] = [[] for _ in range(size)]
        for node in range(1, size):
            by_node[links[node][0]].append(node)
        queue = deque(by_node[0])
        while queue:
            node = queue.popleft()
            queue.extend(by_node[node])
            parent, b = links[node]
            if piece[node]:
                self.closed[node] = 1
                continue
            at, closed = self.fail[parent], self.closed[parent]
            while (at << 8 | b) not in children:
                closed += self.closed[at]
                at = self.fail[at]
            self.fail[node], self.closed[node] = children[at << 8 | b], closed

    @classmethod
    def from_ranks(cls, path: str) -> Automaton:
        """From a file of lines ``base64 rank``."""
        with open(path, "rb") as f:
            return cls(base64.b64decode(line.split()[0]) for line in f if line.strip())

    def count(self, word: bytes) -> int:
        children, fail, closed, node, n = self.children, self.fail, self.closed, 0, 0
        for b in word:
            while (key := node << 8 | b) not in children:
                n += closed[node]
                node = fail[node]
            node = children[key]
        while node:
            n += closed[node]
            node = fail[node]
        return n


class _Words(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(word) <= MAX_WORD_BYTES:
            self[word] = n
        return n


_WORDS: dict[str, _Words] = {}


def count_pieces(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_words, n_pieces, max_word_pieces`` of every whole text. No shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ranks_path not in _WORDS:
            _WORDS[ranks_path] = _Words(Automaton.from_ranks(ranks_path))
        words = _WORDS[ranks_path]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                data = (text.as_py() or "").encode()
                if len(words) > MAX_WORDS:
                    words.clear()
                counts = list(map(words.__getitem__, data.split()))  # bytes.split(): U+0020, U+0009 to U+000D
                rows.append((len(data), len(counts), sum(counts), max(counts, default=0)))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "n_bytes", "n_words", "n_pieces", "max_word_pieces"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_words long, n_pieces long, max_word_pieces long")
