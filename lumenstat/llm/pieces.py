"""Operator 5: token counts by a linear longest-match automaton.

A word is the mark of a word's start and its characters; it is cut greedily into the longest vocabulary
pieces. The automaton is the vocabulary's trie with failure links: from a node, the link leads to where
the rest of the walk stands after the longest pieces have been cut off its front, and the number of these
is stored with it. Reading a word takes time linear in its length and builds no piece.

A word that cannot be cut into pieces counts as one token (unknown), as greedy word-piece encoders have it.
Null and empty texts have no tokens; repeated rows are counted each; an empty table gives an empty result. There are no
ties: the longest piece is one. Words are runs outside space and bytes 9 to 13; case is kept. A text is cut in one
task's memory, at some 60 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenstat.llm.shared import as_bytes, filled, mapped, pieces, without_gc

START = "▁"
CACHE = 300_000


class Automaton:
    """``vocabulary``: pieces; those of a word's start begin with the mark ``start``."""

    def __init__(self, vocabulary: list[str], start: str = START) -> None:
        self.start = start
        self.child: list[dict[str, int]] = [{}]
        final = [False]
        parent, letter, depth = [0], [""], [0]
        for piece in vocabulary:
            at = 0
            for c in piece:
                to = self.child[at].get(c)
                if to is None:
                    to = len(final)
                    self.child[at][c] = to
                    self.child.append({})
                    final.append(False)
                    parent.append(at)
                    letter.append(c)
                    depth.append(depth[at] + 1)
                at = to
            final[at] = bool(piece)
        n = len(final)
        #: Where the walk goes on after the pieces in front are cut; -1: it cannot be cut.
        self.link, self.cut = [-1] * n, [0] * n
        for v in sorted(range(1, n), key=depth.__getitem__):
            if final[v]:
                self.link[v], self.cut[v] = 0, 1
                continue
            at, cut = self.link[parent[v]], self.cut[parent[v]]
            while at >= 0 and letter[v] not in self.child[at]:
                cut += self.cut[at]
                at = self.link[at]
            if at >= 0:
                self.link[v], self.cut[v] = self.child[at][letter[v]], cut

    def count(self, word: str) -> int:
        """Number of greedy longest pieces of a word, 1 if there are none."""
        at, n = 0, 0
        child, link, cut = self.child, self.link, self.cut
        for c in self.start + word:
            to = child[at].get(c)
            while to is None:
                n += cut[at]
                at = link[at]
                if at < 0:
                    return 1
                to = child[at].get(c)
            at = to
        while at:
            n += cut[at]
            at = link[at]
            if at < 0:
                return 1
        return n


def greedy(vocabulary: set[str], word: str, start: str = START) -> int:
    """The plain form of the same count, for tests."""
    rest, n = start + word, 0
    while rest:
        k = next((k for k in range(len(rest), 0, -1) if rest[:k] in vocabulary), 0)
        if not k:
            return 1
        rest, n = rest[k:], n + 1
    return n


_loaded: dict[str, tuple[Automaton, dict[bytes, int]]] = {}


def automaton(path: str) -> tuple[Automaton, dict[bytes, int]]:
    """The automaton of a sentencepiece file's ordinary pieces, and the counts of words seen; kept for the life of a Python worker."""
    if path not in _loaded:
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        ordinary = [p.id_to_piece(i) for i in range(p.vocab_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        _loaded[path] = Automaton(ordinary), {}
    return _loaded[path]


def counted(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_words, n_tokens."""
    kind = docs.schema[id_col].dataType.simpleString()

    @without_gc
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, seen = automaton(path)
        for b in batches:
            texts = as_bytes(b.column(1))
            for lo, hi in pieces([len(t) for t in texts]):
                cut = [t.split() for t in texts[lo:hi]]
                new = {w for c in cut for w in c}
                if len(seen) + len(new) > CACHE:
                    seen.clear()
                for w in new - seen.keys():
                    seen[w] = a.count(w.decode())
                tokens = [sum(map(seen.__getitem__, c)) for c in cut]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.array(list(map(len, cut)), np.int64)), pa.array(tokens, pa.int64())], [id_col, "n_words", "n_tokens"])

    return mapped(docs.select(F.col(id_col), filled(F.col(text_col)).alias("text")), run, f"`{id_col}` {kind}, n_words bigint, n_tokens bigint")
