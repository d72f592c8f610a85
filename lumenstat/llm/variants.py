"""Operator 13: spelling variant grouping by automata of word halves.

Words are runs of ASCII and Latin-1 letters with A-Z lower-cased. By a rule on crc32 of id and run, one run in 97
loses a code point in a document. Words of five code points or more that occur three times or more are the vocabulary.

Two words are near when one inserted, deleted or replaced code point parts them. Of the shorter of two near words (of
equally long ones: the lesser) one half stands whole in the other, the left one at its beginning or the right one at
its end. So the halves of the vocabulary go into Aho-Corasick automata, dealt out by side, length of the word and half.
Every word is scanned by the shards that may hold a half which stands at its beginning or end, of words as long or
shorter by one: four at most, so that the work grows with the vocabulary. A half that is found counts if it stands at
the beginning or at the end and the lengths fit; the rests of the two words are then compared. Each near pair is found
once, whatever shares its halves, and only near pairs leave a task.

A shard with many words, as where a half is common, is cut on both sides into a grid of cells of some 2 SHARD_CHARS code
points in the automaton and PART_CHARS to be scanned (one word at least), so that a cell's memory is bounded.

A word's form is its near word of largest count (ties: least in code-point order), if that is twice its own or more.
Forms rise in count by a factor of two, so that chains are short and their ends are found by doubling.

Null and empty texts have no words; a null id counts as an empty one in the rule. Rows that repeat count each. An empty
table gives an empty result. Extra columns are ignored. A text is split in one task's memory, at some 20 bytes a byte.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lumenstat.llm.shared import Scratch, as_bytes, filled, mapped

LEAST_LENGTH, LEAST_COUNT = 5, 3
ODDS = 97  # one run in so many loses a code point
FACTOR = 2  # a form occurs so many times as often, at least
SHARD_CHARS = 400_000  # code points of the words whose halves one automaton holds, as an aim
PART_CHARS = 4_000_000  # code points of the words that a cell scans
SHORT = 24  # words that share a half and a length are compared one by one, beyond that by their rests without one code point
FLUSH = 200_000  # distinct words that a task counts before it hands them on

_RUN = re.compile("[a-zÀ-ÿ]+")


def counted(docs: DataFrame) -> DataFrame:
    """word, n of all words of LEAST_LENGTH code points or more in ``docs`` (id string, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def batch() -> pa.RecordBatch:
            kept = [(w, n) for w, n in seen.items() if n > 0]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for b in batches:
            for own, text in zip(as_bytes(b.column(0)), as_bytes(b.column(1)), strict=True):
                runs = _RUN.findall(text.lower().decode())  # bytes.lower changes A-Z only
                long = [w for w in runs if len(w) >= LEAST_LENGTH]
                seen.update(long)
                at = crc32(own + b":")
                for w in set(long):
                    h = crc32(w.encode(), at)
                    if h % ODDS == 0:
                        i, n = h % len(w), long.count(w)
                        seen[w] -= n
                        if len(w) > LEAST_LENGTH:
                            seen[w[:i] + w[i + 1 :]] += n
                if len(seen) > FLUSH:
                    yield batch()
                    seen.clear()
        if seen:
            yield batch()

    return mapped(docs, run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def one_edit(a: str, b: str) -> bool:
    """Whether one code point parts ``a`` from ``b``, which differ and of which ``a`` is as long as ``b`` or longer by one."""
    i, end = 0, len(b)
    while i < end and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + (len(a) == end) :]


class Candidates:
    """Words of one length that share a half: their rests, whole, and in long lists also by what is left without one code point."""

    def __init__(self, rests: list[tuple[str, str, int]]) -> None:
        self.rests, self.short = rests, len(rests) <= SHORT
        if not self.short:
            self.whole = {r: (v, n) for r, v, n in rests}  # the half and the rest make the word
            self.open: dict[str, list[tuple[str, int]]] = defaultdict(list)
            for r, v, n in rests:
                for i in range(len(r)):
                    self.open[f"{r[:i]}\0{r[i + 1:]}"].append((v, n))

    def near(self, rest: str, u: str) -> Iterator[tuple[str, int]]:
        """Words one edit away from ``u``, whose rest is ``rest``: shorter by one, or as long and less."""
        if self.short:
            for r, v, n in self.rests:
                if (len(r) < len(rest) or v < u) and one_edit(rest, r):
                    yield v, n
        elif len(self.rests[0][0]) < len(rest):
            for r in {rest[:i] + rest[i + 1 :] for i in range(len(rest))}:
                if r in self.whole:
                    yield self.whole[r]
        else:
            for i in range(len(rest)):
                yield from ((v, n) for v, n in self.open.get(f"{rest[:i]}\0{rest[i + 1:]}", ()) if v < u)


class Halves:
    """Automaton over halves of words (word, count, side 0: the left one, 1: the right one); each half knows its words by length."""

    def __init__(self, words: list[tuple[str, int, int]]) -> None:
        own: dict[str, tuple[dict, dict]] = {}
        for w, n, side in words:
            k = len(w) // 2
            half, rest = (w[k:], w[:k]) if side else (w[:k], w[k:])
            own.setdefault(half, ({}, {}))[side].setdefault(len(w), []).append((rest, w, n))
        self.automaton = ahocorasick.Automaton()
        for half, sides in own.items():
            self.automaton.add_word(half, (len(half), *({m: Candidates(r) for m, r in by.items()} for by in sides)))
        if own:
            self.automaton.make_automaton()

    def near(self, u: str) -> dict[str, int]:
        """Counts of the words near ``u`` that are shorter than it, or as long and less. A word both of whose halves stand in
        ``u`` is left to its left half."""
        found: dict[str, int] = {}
        size = len(u)
        for end, (k, heads, tails) in self.automaton.iter(u) if len(self.automaton) else ():
            if end == k - 1:
                for m in (size - 1, size):
                    if m in heads:
                        found.update(heads[m].near(u[k:], u))
            if end == size - 1:
                for m in (size - 1, size):
                    if m in tails:
                        found.update((v, n) for v, n in tails[m].near(u[: size - k], u) if not u.startswith(v[: m - k]))
        return found


def _shard(side: int, length: Column, half: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(side), length.cast("int"), half), F.lit(shards)).cast("int")


def near_words(words: DataFrame, shard_chars: int = SHARD_CHARS, part_chars: int = PART_CHARS) -> DataFrame:
    """word, near, near_n: every near pair of ``words`` (word, n; distinct), both ways."""
    chars = words.agg(F.coalesce(F.sum(F.length("word")), F.lit(0))).first()[0]
    shards = max(1, -(-2 * chars // shard_chars))
    w, size = F.col("word"), F.length("word")
    cut = F.floor(size / 2).cast("int")
    sides = F.array(*[F.struct(_shard(k, size, half, shards).alias("shard"), F.lit(k).alias("side")) for k, half in ((0, F.substring(w, F.lit(1), cut)), (1, F.substring(w, cut + 1, size - cut)))])
    held = words.select("word", "n", F.explode(sides).alias("s")).select("word", "n", "s.shard", "s.side")
    goes = []
    for m in (size, size - 1):  # the lengths that a near word may have here
        k = F.floor(m / 2).cast("int")
        goes += [_shard(0, m, F.substring(w, F.lit(1), k), shards), _shard(1, m, F.substring(w, size - m + k + 1, m - k), shards)]
    scanned = words.select("word", "n", F.explode(F.array_distinct(F.array(*goes))).alias("shard"))
    # a shard of many words, as where they share a half, is cut on both sides
    long = lambda df, name, most: df.groupBy("shard").agg(F.ceil(F.sum(F.length("word")) / most).cast("int").alias(name))
    cells = long(held, "holds", 2 * shard_chars).join(long(scanned, "parts", part_chars), "shard")
    dealt = lambda n, seed: F.pmod(F.xxhash64("word", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = scanned.join(cells, "shard").withColumn("part", dealt("parts", 1)).withColumn("hold", every("holds"))
    right = held.join(cells, "shard").withColumn("hold", dealt("holds", 2)).withColumn("part", every("parts"))
    left, right = (df.select(*c).toDF(*c) for df, c in ((left, ["shard", "part", "hold", "word", "n"]), (right, ["shard", "part", "hold", "word", "n", "side"])))
    keys = ("shard", "part", "hold")

    def search(scanned: pa.Table, held: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if held.num_rows and scanned.num_rows:
            halves = Halves(list(zip(*[held[c].to_pylist() for c in ("word", "n", "side")], strict=True)))
            for u, n in zip(scanned["word"].to_pylist(), scanned["n"].to_pylist(), strict=True):
                for v, m in halves.near(u).items():
                    out[0].extend((u, v))
                    out[1].extend((v, u))
                    out[2].extend((m, n))
        return pa.table({"word": pa.array(out[0], pa.string()), "near": pa.array(out[1], pa.string()), "near_n": pa.array(out[2], pa.int64())})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "word string, near string, near_n bigint")


def rooted(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``forms`` (word, form) as word, root: forms followed to the last, by doubling."""
    now = scratch.write(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        seen, ahead = Observation(), now.toDF("root", "further")
        then = now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        now = scratch.write(then.observe(seen, F.count_if("moved").alias("moved")).select("word", "root"), "roots")
        if not seen.get["moved"]:
            return now


def grouped(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", shard_chars: int = SHARD_CHARS, part_chars: int = PART_CHARS) -> DataFrame:
    """A row for each word of the vocabulary: word, form, root, n, n_near, form_n."""
    source = docs.select(filled(F.col(id_col).cast("string")).alias("id"), filled(F.col(text_col)).alias("text"))
    words = scratch.write(counted(source).filter(F.col("n") >= LEAST_COUNT), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(words, shard_chars, part_chars).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    top = -F.col("best.less")
    has = top >= FACTOR * F.col("n")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, top).alias("form_n"))
    found = scratch.write(found, "forms")
    roots = rooted(found.filter("form IS NOT NULL"), scratch)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
