"""Greedy longest-match token counts by a linear automaton.

The vocabulary is a trie. Each node holds the number of tokens popped and a
failure link for when the next byte has no edge: at a node that stands for a
string s, the longest vocabulary prefix of s is popped, then further longest
matches from what follows, until a node is reached whose string is a suffix of
s that can still grow. A word is then read once, a popped count is added at
each failure, and no pieces are built. Words repeat, so their counts are
remembered per worker.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import held, slices
from .word_cache import byte_alphabet


class LongestMatch:
    """Counts greedy longest-match pieces of byte strings over ``vocabulary``.

    Every single byte counts as a piece, so that any word can be cut.
    """

    def __init__(self, vocabulary: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}]
        whole = [False]
        up: list[tuple[int, int]] = [(0, 0)]
        for token in [*(bytes([b]) for b in range(256)), *vocabulary]:
            node = 0
            for b in token:
                child = self.next[node].get(b)
                if child is None:
                    child = self.next[node][b] = len(self.next)
                    self.next.append({})
                    whole.append(False)
                    up.append((node, b))
                node = child
            whole[node] = node > 0
        self.fail, self.popped = self._link(whole, up)

    def _link(self, whole: list[bool], up: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
        """Failure links and popped counts, nodes by depth.

        A node that is a token pops itself. Otherwise the parent's failure
        state reads the node's byte, failing onward and adding up its pops.
        """
        fail, popped = [0] * len(up), [0] * len(up)
        level = [0]
        while level:
            level = [c for n in level for c in self.next[n].values()]
            for node in level:
                if whole[node]:
                    popped[node] = 1
                    continue
                parent, b = up[node]
                at, n = fail[parent], popped[parent]
                while b not in self.next[at]:
                    n += popped[at]
                    at = fail[at]
                fail[node], popped[node] = self.next[at][b], n
        return fail, popped

    def count(self, word: bytes) -> int:
        node, n = 0, 0
        edges, fail, popped = self.next, self.fail, self.popped
        for b in word:
            child = edges[node].get(b)
            while child is None:
                n += popped[node]
                node = fail[node]
                child = edges[node].get(b)
            node = child
        while node:
            n += popped[node]
            node = fail[node]
        return n


def byte_level_vocabulary(path: str) -> list[bytes]:
    """Tokens of a byte-level tokenizer file as bytes; those that aren't byte strings are left out.
    """
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    return [bytes(map(byte_of.__getitem__, t)) for t in model["vocab"] if t and all(map(byte_of.__contains__, t))]


def count_tokens(docs: DataFrame, path: str, limit: int = 500_000, longest: int = 200) -> DataFrame:
    """Per row: doc_id, n_words and n_tokens of the whole text.

    A word is a run of bytes other than ASCII white space; it is matched with
    one space before it, so tokens that start a word begin with a space. Null
    and empty texts count zero; repeated rows repeat; other columns are
    ignored. ``limit`` and ``longest`` bound the words remembered, not those
    counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = held((LongestMatch, path), lambda: (LongestMatch(byte_level_vocabulary(path)), {}))
        for batch in slices(batches):
            n_words, n_tokens = [], []
            for text in batch.column(1).to_pylist():
                words = (text or "").encode().split()
                for w in set(words).difference(known):
                    if len(w) <= longest:
                        known[w] = automaton.count(b" " + w)
                try:
                    total = sum(map(known.__getitem__, words))
                except KeyError:
                    total = sum(known[w] if w in known else automaton.count(b" " + w) for w in words)
                n_words.append(len(words))
                n_tokens.append(total)
            if len(known) > limit:
                known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
