"""Operator 1: BPE encoding and decoding by a segment tree over adjacent pair ranks.

Leaf i of a word's tree holds rank and place of the pair that starts at symbol i; an inner node
holds the least of its children, so the root is the leftmost pair of lowest rank. A merge changes
three leaves and their ancestors. Short words are merged many at a time, a tree in each row of one
array; long ones in a tree of their own.

Null and empty texts have no tokens. Each text is taken whole; special-token strings inside a text
become their special ids, as the tokenizers library does by default. Repeated rows are encoded each; an empty
table gives an empty result. Pairs of equal rank merge from the left. A text may be of any length that fits a task's
memory, at some 200 bytes a character for its longest word and 10 for the rest.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenstat.llm.shared import filled, mapped, without_gc

NONE = np.int64(1) << 62
PLACE_BITS = 40  # of a place in a word, below the rank in a tree's keys
WIDE = 32  # longest word of the row-wise form
CACHE = 250_000  # words remembered by a Python worker
#: Texts with any of these are normalised and split by the library's own parts: combining and rarer letters, and control characters that str.split takes for white space.
_ODD = re.compile("[\x00\x1c-\x1f\u0300-\U0010ffff]")
READY = "\0"  # before a piece that is byte-level already
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: visible Latin-1 for itself, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Tokenizer:
    """Vocabulary and merges of a tokenizers file with word-end BPE after lower-casing and splitting."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        self.named = {i: str(i) for i in self.strings}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = (np.array([self.vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        key, rank = left << 32 | right, np.arange(len(merges))
        order = np.argsort(key, kind="stable")
        key, rank = key[order], rank[order]
        last = np.append(key[1:] != key[:-1], True)  # of a repeated merge the last rank counts
        self.keys, self.ranks = key[last], rank[last]
        self.made = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        letters = byte_letters()
        self.bytes_of = {c: b for b, c in letters.items()}
        self.inner = np.array([self.vocab.get(letters[b], -1) for b in range(256)], np.int64)
        self.final = np.array([self.vocab.get(letters[b] + self.end, -1) for b in range(256)], np.int64)
        self.whole = bool((self.inner >= 0).all() and (self.final >= 0).all())
        self.cut = regex.compile(_SPLIT)
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.path, self.library = path, None
        self.cache: dict[str, tuple[str, str, int]] = {}

    def symbols(self, piece: bytes) -> list[int]:
        """Ids of a piece's bytes, the last with the word end; those outside the vocabulary vanish."""
        found = [*self.inner[list(piece[:-1])].tolist(), int(self.final[piece[-1]])]
        return [i for i in found if i >= 0]

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where there is no merge or no symbol."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], -1)

    def merge_long(self, ids: list[int]) -> list[int]:
        """One tree for one word."""
        n = len(ids)
        size = 1 << max(0, (n - 1).bit_length())
        nxt, prv = [*range(1, n), -1], list(range(-1, n - 1))
        none, rank_of, made = int(NONE), self.rank_of, self.made
        tree = [none] * (2 * size)

        def leaf(i: int) -> int:
            r = rank_of.get(ids[i] << 32 | ids[nxt[i]]) if nxt[i] >= 0 else None
            return none if r is None else r << PLACE_BITS | i

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            k >>= 1
            while k:
                tree[k] = min(tree[2 * k], tree[2 * k + 1])
                k >>= 1

        for i in range(n):
            tree[size + i] = leaf(i)
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        while tree[1] < none:
            i = tree[1] & ((1 << PLACE_BITS) - 1)
            j = nxt[i]
            ids[i] = int(made[tree[1] >> PLACE_BITS])
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            put(j, none)
            put(i, leaf(i))
            if prv[i] >= 0:
                put(prv[i], leaf(prv[i]))
        out, i = [], 0
        while i >= 0 and n:
            out.append(ids[i])
            i = nxt[i]
        return out

    def merge_rows(self, sym: np.ndarray) -> tuple[list[int], np.ndarray]:
        """One tree in each row; symbols of a word of at most WIDE, then -1. Returns all ids in turn, and each row's number."""
        n, size = sym.shape
        place = np.arange(size)
        width = (sym >= 0).sum(1)
        nxt = np.where(place + 1 < width[:, None], place + 1, -1)
        prv = np.broadcast_to(place - 1, (n, size)).copy()
        tree = np.full((n, 2 * size), NONE)
        rank = self.pair_ranks(sym[:, :-1], sym[:, 1:])
        tree[:, size:-1] = np.where(rank >= 0, rank << 8 | place[:-1], NONE)
        for k in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])

        def put(r: np.ndarray, i: np.ndarray, value: np.ndarray | np.int64) -> None:
            k = i + size
            tree[r, k] = value
            while True:
                k >>= 1
                tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])
                if k[0] == 1:
                    return

        def leaf(r: np.ndarray, i: np.ndarray) -> np.ndarray:
            j = nxt[r, i]
            rank = self.pair_ranks(sym[r, i], np.where(j >= 0, sym[r, j], -1))
            return np.where(rank >= 0, rank << 8 | i, NONE)

        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            root = tree[live, 1]
            i = root & 0xFF
            j = nxt[live, i]
            sym[live, i] = self.made[root >> 8]
            sym[live, j] = -1
            after = nxt[live, j]
            nxt[live, i] = after
            has = after >= 0
            prv[live[has], after[has]] = i[has]
            put(live, j, NONE)
            put(live, i, leaf(live, i))
            before = prv[live, i]
            has = before >= 0
            if has.any():
                put(live[has], before[has], leaf(live[has], before[has]))
            live = live[tree[live, 1] < NONE]
        kept = sym >= 0
        return sym[kept].tolist(), kept.sum(1)

    def merge(self, pieces: list[bytes]) -> list[tuple[str, str, int]]:
        """Of each piece: ids and token strings, joined by spaces, and the number of tokens."""
        out: list[tuple[str, str, int]] = [("", "", 0)] * len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        first = np.concatenate([[0], np.cumsum(length)[:-1]])
        data = np.frombuffer(b"".join(pieces) + b"\0" * WIDE, np.uint8)
        short = (length <= WIDE) & (length > 0) if self.whole else np.zeros(len(pieces), bool)
        size, low = 2, 0
        while size <= WIDE:
            rows = np.flatnonzero(short & (length > low) & (length <= size))
            for lo in range(0, len(rows), 20_000):
                some = rows[lo : lo + 20_000]
                place = np.arange(size)
                sym = self.inner[data[first[some, None] + place]]
                sym[place >= length[some, None]] = -1
                sym[np.arange(len(some)), length[some] - 1] = self.final[data[first[some] + length[some] - 1]]
                ids, count = self.merge_rows(sym)
                named, strings = [self.named[i] for i in ids], [self.strings[i] for i in ids]
                at = 0
                for k, n in zip(some.tolist(), count.tolist(), strict=True):
                    if n == 1:
                        out[k] = (named[at], strings[at], 1)
                    else:
                        out[k] = (" ".join(named[at : at + n]), " ".join(strings[at : at + n]), n)
                    at += n
            size, low = 2 * size, size
        for k in np.flatnonzero(~short & (length > 0)).tolist():
            ids = self.merge_long(self.symbols(pieces[k]))
            out[k] = (" ".join([self.named[i] for i in ids]), self.decode(ids), len(ids))
        return out

    def _words(self, text: str) -> list[str]:
        """Normalised words between white space; none is cut off by what stands before it."""
        if _ODD.search(text):
            if self.library is None:
                from tokenizers import Tokenizer as Library

                self.library = Library.from_file(self.path)
            clean = self.library.normalizer.normalize_str(text)
            return [READY + p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(clean)]
        return text.lower().split()

    def segments(self, text: str) -> list[list[str] | str]:
        """Words of what stands between special tokens, and these, as strings, in their places."""
        if self.specials is None or "<|" not in text:
            return [self._words(text)]
        return [p if i % 2 else self._words(p) for i, p in enumerate(self.specials.split(text))]

    def learn(self, words: set[str]) -> None:
        """Put words into the cache: ids and token strings joined by spaces, and the number of tokens."""
        cut = {w: (w,) if w[0] == READY or w.isalpha() else self.cut.findall(w) for w in words}
        pieces = list({p for c in cut.values() for p in c})
        raw = [bytes([self.bytes_of[x] for x in p[1:]]) if p[0] == READY else p.encode() for p in pieces]
        merged = dict(zip(pieces, self.merge(raw), strict=True))
        cache = self.cache
        for w, c in cut.items():
            if len(c) == 1:
                cache[w] = merged[c[0]]
            else:
                a, b, n = zip(*[merged[p] for p in c], strict=True) if c else ((), (), ())
                cache[w] = (" ".join(filter(None, a)), " ".join(filter(None, b)), sum(n))

    def decode(self, ids: list[int]) -> str:
        """The library's decode of a file without a decoder: token strings joined by spaces."""
        strings = self.strings
        return " ".join([strings[i] for i in ids if i in strings])

    def encode_all(self, texts: list[str]) -> Iterator[tuple[list[str], list[str], int]]:
        """For each text: id strings, decoded strings (each of one or more tokens), and the number of tokens."""
        cut = [self.segments(t) for t in texts]
        seen = {w for c in cut for s in c if isinstance(s, list) for w in s}
        if len(self.cache) + len(seen) > CACHE:
            self.cache.clear()
        self.learn(seen - self.cache.keys())
        get = self.cache.__getitem__
        for c in cut:
            ids, strings, n = [], [], 0
            for s in c:
                if isinstance(s, str):
                    ids.append(str(self.special[s]))
                    strings.append(s)
                    n += 1
                elif s:
                    a, b, k = zip(*map(get, s), strict=True)
                    ids += a
                    strings += b
                    n += sum(k)
            yield [x for x in ids if x] if "" in ids else ids, [x for x in strings if x] if "" in strings else strings, n

    def encode(self, text: str) -> list[int]:
        ids, _, _ = next(self.encode_all([text]))
        return [int(i) for x in ids for i in x.split(" ")]


_loaded: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """Kept for the life of a Python worker."""
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256; with ``with_ids`` also the ids and the decoded text."""
    kind = docs.schema[id_col].dataType.simpleString()

    @without_gc
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size < 1_500_000):
                    size += len(texts[hi])
                    hi += 1
                n, a, d, ids, decoded = [], [], [], [], []
                for x, y, k in t.encode_all(texts[lo:hi]):
                    x, y = " ".join(x), " ".join(y)
                    n.append(k)
                    a.append(hashlib.sha256(x.encode()).hexdigest())
                    d.append(hashlib.sha256(y.encode()).hexdigest())
                    if with_ids:
                        ids.append([int(i) for i in x.split()])
                        decoded.append(y)
                cols = [b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols += [pa.array(ids, pa.list_(pa.int64())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)
                lo = hi
        t.cache.clear()  # the worker may run other operators next

    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<bigint>, decoded string" if with_ids else "")
    return mapped(docs.select(F.col(id_col), filled(F.col(text_col)).alias("text")), run, schema)
