"""Token counts by a linear longest-match automaton, without building the pieces.

Greedy word-piece: from the start of a word take the longest vocabulary entry, then the longest continuation entry,
and so on.  The automaton is a trie of both kinds with failure links.  Each state also knows how many pieces the
greedy rule has settled when the next byte does not fit ("popped") and where it goes on, so every byte of a word
is looked at once, whatever the vocabulary; a word's length is the sum of popped counts on its way.

The vocabulary comes from a public byte-level BPE file: entries that begin with the mark of a space start a word,
the others continue one.  All single bytes must be entries, as they are in such a file, so no word is unknown; a
vocabulary without some byte makes a word with it one unknown piece.

Words are ``[^\\x20\\x09-\\x0D]+`` in UTF-8.  Edge cases: null and empty texts and texts of white space have no words
and no tokens; very long words cost time linear in their bytes; repeated rows are counted one by one; an empty
table gives an empty result; extra columns pass through, except those named like a result column, which are replaced.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatehouse.llm.tokens import byte_alphabet

_ADDED = ("n_words", "n_tokens")
#: Word lengths remembered per worker; the memory is emptied when full, so its size is bounded.
_REMEMBER = 300_000


class Counter:
    """The automaton over two sets of byte strings."""

    START, INNER = 0, 1

    def __init__(self, first: set[bytes], later: set[bytes]):
        self.goto: list[dict[int, int]] = [{}, {}]
        ends = [False, False]
        roots = [self.START, self.INNER]
        for root, entries in ((self.START, first), (self.INNER, later)):
            for entry in entries:
                at = root
                for byte in entry:
                    if byte not in self.goto[at]:
                        self.goto.append({})
                        ends.append(False)
                        self.goto[at][byte] = len(ends) - 1
                    at = self.goto[at][byte]
                ends[at] = True
        n = len(ends)
        # fail[s]: state after settling popped[s] pieces, or -1 if the word cannot be split this way
        self.fail, self.popped = [-1] * n, [0] * n
        todo = deque(roots)
        while todo:
            s = todo.popleft()
            for byte, t in self.goto[s].items():
                if ends[t]:
                    self.fail[t], self.popped[t] = self.INNER, 1
                else:
                    z, pops = self.fail[s], self.popped[s]
                    while z != -1 and byte not in self.goto[z]:
                        z, pops = self.fail[z], pops + self.popped[z]
                    if z != -1:
                        self.fail[t], self.popped[t] = self.goto[z][byte], pops
                todo.append(t)

    def length(self, word: bytes) -> int:
        """Number of greedy pieces of a word that is not empty; 1 if it cannot be split (unknown)."""
        goto, fail, popped = self.goto, self.fail, self.popped
        s, pieces = self.START, 0
        for byte in word:
            while byte not in goto[s]:
                if fail[s] == -1:
                    return 1
                pieces += popped[s]
                s = fail[s]
            s = goto[s][byte]
        while s != self.INNER:
            if fail[s] == -1:
                return 1
            pieces += popped[s]
            s = fail[s]
        return pieces


def load_vocabulary(path: str) -> tuple[set[bytes], set[bytes]]:
    """``(word starts, continuations)`` of a byte-level BPE file, special tokens aside."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens") or []}
    alphabet = byte_alphabet()
    entries = {bytes(alphabet[c] for c in piece) for piece in spec["model"]["vocab"] if piece not in special}
    first = {e[1:] for e in entries if e[:1] == b" " and len(e) > 1}
    later = {e for e in entries if e[:1] != b" "}
    # a word may start with any single byte
    return first | {e for e in later if len(e) == 1}, later


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(*load_vocabulary(path))


class _Lengths(dict):
    """Word -> number of pieces, computed at the first sight of a word."""

    def __init__(self, automaton: Counter):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBER:
            self.clear()
        n = self.automaton.length(word)
        if len(word) <= 64:
            self[word] = n
        return n


def count_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words`` and ``n_tokens``: one narrow pass."""
    kept = [c for c in docs.columns if c not in _ADDED or c == text_col]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(kept)])
    at = kept.index(text_col)
    schema = T.StructType([*inner.schema.fields, *(T.StructField(c, T.LongType()) for c in _ADDED)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _Lengths(counter(vocabulary))
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(at):
                found = (text.as_py() or "").encode().split()
                words.append(len(found))
                tokens.append(sum(map(lengths.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=schema.names)

    counted = inner.mapInArrow(count, schema)
    return counted.select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(kept)], *_ADDED)
