"""Operator 10: n-gram Jaccard join by grouped prefixes.

A document is the set of its distinct word shingles (A-Z lower-cased; shorter texts: the whole sequence
as one; no words: empty, linked with nothing). Two documents link when 100 * intersection >= percent * union.

Shingles are 64-bit hashes in one global order: rough document frequency first (a sketch of fixed size,
so that frequent lines and passages come last), then hash. Any such order is right for the prefix filter:
sets that link share one of their first ``n - ceil(percent * n / 100) + 1`` shingles. Documents of equal
sets are one node; nodes of equal size and prefix are one group, and only groups are indexed by shingle.

Links are found in two rounds, so that a large group of near copies never becomes all its pairs. First each
group meets only HUBS groups of each shingle's list, picked by hashes of shingle and group so that lists differ in
them. Then the lists are searched for all pairs of groups still not connected. Group pairs are filtered by size, by
the places of their shingle, by signatures and by their common prefix, expanded to members, and verified on whole
sets. Thus all components are exact, while links within a component that the first round has connected need not be
spelled out. A signature holds the parity of the shingles in each cell, of the prefix and, in groups of one member,
of the whole set: two signatures differ in no more bits than the sets differ in shingles, so that a pair that fails
cannot link.

What meets on the driver is of fixed size: half a byte for each cell of the sketch, which is summed on the
executors, and a bitmap of the documents whose whole sets are wanted (a hashed filter, made exact by a join).
A text's shingles are held in one task's memory, at some 60 bytes a word.

Null texts count as empty; null ids take no part in the least id. Repeated rows are one node. Extra
columns are ignored. An empty table gives an empty result. Equal similarity is no tie here: all links count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstat.llm.components import components
from lumenstat.llm.shared import Scratch, as_bytes, filled, mapped, pieces, spare
from lumenstat.llm.words import Batch, mix, shingles

SKETCH_BITS = 22  # counters of the frequency sketch; 4 bits each are broadcast
SIGN_BITS = {"bits": 256, "whole": 512}  # bits of the signatures of a prefix and of a whole set, multiples of 64
HUBS = 3  # groups of each list that all others meet in the first round
MASK_BITS = (16, 28)  # least and most bits, as powers of two, of the bitmap of documents whose whole sets are wanted; the rest is left to the join
BLOCK = 1 << 10  # cells of the sketch in a row


def frequency_classes(docs: DataFrame, width: int, scratch: Scratch, bits: int = SKETCH_BITS) -> bytes:
    """Class 0 to 15 of each of 2**bits cells by how often its shingles occur, packed by two; computed from every document."""
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, wait, n = np.zeros(size, np.uint32), [], 0
        for b in batches:
            texts = as_bytes(b.column(0))
            for lo, hi in pieces([len(t) for t in texts]):
                found = shingles(Batch(texts[lo:hi]), width)
                wait += [(x & np.uint64(size - 1)).astype(np.int64) for x in found]
                n += sum(map(len, found))
                if n > 1_000_000:
                    np.add(total, np.bincount(np.concatenate(wait), minlength=size), out=total, casting="unsafe")
                    wait, n = [], 0
        if n:
            np.add(total, np.bincount(np.concatenate(wait), minlength=size), out=total, casting="unsafe")
        cells = total.reshape(-1, BLOCK)
        some = np.flatnonzero(cells.any(1))
        for lo in range(0, len(some), 256):
            part = some[lo : lo + 256]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([cells[k].astype("<u4").tobytes() for k in part], pa.binary())], ["block", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of rows that come block by block."""
        block, total = None, np.zeros(BLOCK, np.uint64)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.astype("<u8").tobytes()], pa.binary()), pa.array([int(total.sum())], pa.int64())], ["block", "cells", "n"])

        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != block:
                    if block is not None:
                        yield row()
                    block, total = k, np.zeros(BLOCK, np.uint64)
                total += np.frombuffer(x, "<u4")
        if block is not None:
            yield row()

    def graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cells = np.frombuffer(x, "<u8")
                kind = np.where(cells > usual, np.minimum(1 + np.log2(np.maximum(cells, 1) / usual), 15), 0).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_pack(kind)], pa.binary())], ["block", "cells"])

    parts = mapped(docs.select("text"), count, "block int, cells binary")
    sums = scratch.write(mapped(parts.repartition("block").sortWithinPartitions("block"), add, "block int, cells binary, n bigint"), "sketch")
    usual = 4 + 2 * (sums.agg(F.sum("n")).first()[0] or 0) / size
    out = bytearray(size // 2)
    for row in mapped(sums.select("block", "cells"), graded, "block int, cells binary").collect():
        out[row["block"] * BLOCK // 2 : (row["block"] + 1) * BLOCK // 2] = row["cells"]
    scratch.drop(sums)
    return bytes(out)


def ordered(found: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Signed 64-bit keys of a set in the global order: class in the high bits, then the hash."""
    kind = classes[(found & np.uint64(len(classes) - 1)).astype(np.int64)].astype(np.uint64)
    key = (kind << np.uint64(59)) | (mix(found) >> np.uint64(5))
    key.sort()
    return key.view(np.int64)


def prefix_length(n: int, percent: int) -> int:
    """0 where no other set can link: a neighbour in size shares n of n + 1 at most."""
    return 0 if 100 * n < percent * (n + 1) else n - -(-percent * n // 100) + 1


def signature(tokens: np.ndarray, bits: int) -> bytes:
    """Parity of the shingles in each of ``bits`` cells."""
    odd = np.bincount(tokens & np.int64(bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _pack(classes: np.ndarray) -> bytes:
    return (classes[0::2] | classes[1::2] << 4).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return np.stack([raw & 15, raw >> 4], 1).reshape(-1)


def _sets(docs: DataFrame, width: int, percent: int, classes: object, extra: list[str], mask: object = None, mask_bits: int = 0) -> DataFrame:
    """doc_id, node, n, tokens, bits, whole: the prefix of each document's set and the signatures; with a mask, whole sets, unsigned, of documents that it has."""
    signs = list(SIGN_BITS) if mask is None else []
    own = ["doc_id", "node", "n", "tokens", *signs]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _unpack(classes.value)
        wanted = None if mask is None else np.frombuffer(mask.value, np.uint8)
        for b in batches:
            texts, ids = as_bytes(b.column(1)), b.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            for lo, hi in pieces([len(t) for t in texts]):
                nodes, sizes, out, rows, sets = [], [], [], [], []
                take = range(lo, hi) if wanted is None else [i for i, at in zip(range(lo, hi), (ids[lo:hi] & ((1 << mask_bits) - 1)).tolist(), strict=True) if wanted[at >> 3] >> (at & 7) & 1]
                for i, found in zip(take, shingles(Batch([texts[i] for i in take]), width), strict=True):
                    # the node is a hash of the whole set; the empty set has node 0
                    node = np.int64(0) if not len(found) else (mix(np.bitwise_xor.reduce(mix(found ^ np.uint64(0x5BD1E995)))[None] + found.sum(dtype=np.uint64))).view(np.int64)[0]
                    if wanted is not None:
                        out.append(ordered(found, table))
                    else:
                        sets.append(ordered(found, table))
                        out.append(sets[-1][: prefix_length(len(found), percent) if len(found) else 0])
                    rows.append(i)
                    nodes.append(node)
                    sizes.append(len(found))
                if rows:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in out])])
                    tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(out), pa.int64()))
                    cols = [b.column(0).take(pa.array(rows)), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), tokens]
                    for name, of in zip(signs, (out, sets), strict=False):
                        words = np.frombuffer(b"".join(signature(x, SIGN_BITS[name]) for x in of), np.int64)
                        cols.append(pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * (SIGN_BITS[name] // 64), pa.int32()), pa.array(words, pa.int64())))
                    yield pa.RecordBatch.from_arrays(cols + [b.column(2 + k).take(pa.array(rows)) for k in range(len(extra))], [*own, *extra])

    return mapped(docs.select("doc_id", "text", *extra), run, ", ".join(f"{c} {'array<bigint>' if c in ('tokens', *signs) else 'bigint'}" for c in own) + (f", {kinds}" if extra else ""))


def _mask(wanted: DataFrame, mask_bits: int) -> bytes:
    """A bitmap of the low bits of the ids wanted."""
    at = F.coalesce("doc_id", F.lit(-1)).bitwiseAND(F.lit((1 << mask_bits) - 1))
    bits = wanted.select((at + 1).alias("at")).groupBy(F.expr("bitmap_bucket_number(at)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits"))
    step = 4096  # bytes of one bitmap
    out = bytearray(max(step, (1 << mask_bits) // 8))
    for row in bits.collect():
        out[(row["k"] - 1) * step : row["k"] * step] = row["bits"]
    return bytes(out)


def _links_enough(common: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * common >= percent * (a + b - common)


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _leads(i: Column, j: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether a shingle at places i and j of the orders can be the first one common to sets of sizes a and b that link."""
    need = F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent) - 1e-9)
    return F.least(a - i, b - j) >= need


def _signs_fit(x: str, y: str, percent: int) -> Column:
    """Whether structs x and y (n, p, last, bits, whole or null) may share enough: each cell whose parity differs holds a shingle of one alone."""

    def apart(name: str) -> Column:
        return sum((F.bit_count(F.col(f"{x}.{name}")[k].bitwiseXOR(F.col(f"{y}.{name}")[k])) for k in range(SIGN_BITS[name] // 64)), F.lit(0))

    a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
    rest = F.when(F.col(f"{x}.last") <= F.col(f"{y}.last"), a - F.col(f"{x}.p")).otherwise(b - F.col(f"{y}.p"))
    need = F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent) - 1e-9)
    return F.coalesce(a + b - apart("whole") >= 2 * need, F.col(f"{x}.p") + F.col(f"{y}.p") - apart("bits") >= 2 * (need - rest))


def joined(docs: DataFrame, scratch: Scratch, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", carry: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (the least doc_id reachable by links), node, and ``carry`` (SQL, name) columns."""
    sc = scratch.spark.sparkContext
    extra = [name for _, name in carry]
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), filled(F.col(text_col)).alias("text"), *[F.expr(sql).alias(name) for sql, name in carry])
    mask_bits = min(max(docs.count().bit_length() + 2, MASK_BITS[0]), MASK_BITS[1])
    classes = sc.broadcast(frequency_classes(docs, width, scratch))
    rows = scratch.write(_sets(docs, width, percent, classes, extra), "rows")
    # equal sets are one node; its least document lends the set
    nodes = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), *[F.first(c).alias(c) for c in SIGN_BITS])
    nodes = scratch.write(nodes.filter(F.size("tokens") > 0).withColumn("gkey", F.xxhash64("n", "tokens")), "nodes")
    heads = scratch.write(nodes.groupBy("gkey").agg(F.min("node").alias("g"), F.count("*").alias("k")), "heads")
    members = nodes.join(heads, "gkey").select("g", "node", "doc_id", "n")
    groups = nodes.join(heads, (nodes["gkey"] == heads["gkey"]) & (nodes["node"] == heads["g"])).select("g", "n", "tokens", "bits", F.when(F.col("k") == 1, F.col("whole")).alias("whole"))
    members, groups = scratch.write(members, "members"), scratch.write(groups, "groups")
    scratch.drop(nodes)
    lists = groups.select("g", F.col("n").cast("int").alias("n"), F.posexplode("tokens").alias("at", "token"))
    shared = scratch.write(lists.join(lists.groupBy("token").count().filter("count > 1").select("token"), "token"), "lists")  # lists of two groups or more

    signs = groups.select("g", F.struct("n", F.size("tokens").alias("p"), F.element_at("tokens", -1).alias("last"), *SIGN_BITS).alias("sign"))
    prefixes = groups.select("g", "tokens", F.element_at("tokens", -1).alias("last"), F.size("tokens").alias("p"))

    def possible(pairs: DataFrame, common: Column | None = None) -> DataFrame:
        """Group pairs (a, b, na, nb) whose common prefix leaves room for a link."""
        a = prefixes.select(F.col("g").alias("a"), F.col("tokens").alias("ta"), F.col("last").alias("la"), F.col("p").alias("pa"))
        b = prefixes.select(F.col("g").alias("b"), F.col("tokens").alias("tb"), F.col("last").alias("lb"), F.col("p").alias("pb"))
        both = pairs.join(a, "a").join(b, "b")
        count = F.size(F.array_intersect("ta", "tb"))
        rest = F.when(F.col("la") <= F.col("lb"), F.col("na") - F.col("pa")).otherwise(F.col("nb") - F.col("pb"))
        return both.filter(_links_enough(count + rest, F.col("na"), F.col("nb"), percent)).select("a", "b")

    def verified(pairs: DataFrame) -> DataFrame:
        """Of node pairs (u, v), those that link, by whole sets."""
        pairs = scratch.write(pairs.filter("u <> v").distinct(), "pairs")
        ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
        wanted = scratch.write(members.join(ends, "node").select("node", "doc_id"), "wanted")
        mask = sc.broadcast(_mask(wanted, mask_bits))
        full = _sets(docs, width, percent, classes, [], mask, mask_bits).join(wanted.withColumnRenamed("doc_id", "w"), "node", "left_semi")
        full = scratch.write(full.select("node", "n", "tokens").dropDuplicates(["node"]), "full")
        a, b = full.toDF("u", "nu", "tu"), full.toDF("v", "nv", "tv")
        found = pairs.join(a, "u").join(b, "v").filter(_links_enough(F.size(F.array_intersect("tu", "tv")), F.col("nu"), F.col("nv"), percent))
        out = scratch.write(found.select("u", "v"), "links")
        scratch.drop(full)
        mask.destroy()
        return out

    # first round: each group and the hubs of each of its lists; within a group the least member
    picks = [F.min(F.struct(F.xxhash64("g", "token", F.lit(k)).alias("pick"), "g", "n", "at")) for k in range(HUBS)]
    hubs = shared.groupBy("token").agg(F.array_distinct(F.array(*picks)).alias("hubs"))
    stars = shared.join(hubs, "token").select("g", "n", "at", F.explode("hubs").alias("c")).filter(F.col("g") != F.col("c.g"))
    stars = stars.filter(_leads(F.col("c.at"), F.col("at"), F.col("c.n"), F.col("n"), percent) & _sizes_fit(F.col("c.n"), F.col("n"), percent))
    stars = stars.select(F.least("g", "c.g").alias("a"), F.greatest("g", "c.g").alias("b")).distinct()
    stars = stars.join(signs.toDF("a", "x"), "a").join(signs.toDF("b", "y"), "b").filter(_signs_fit("x", "y", percent)).select("a", "b", F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
    inner = members.filter("node <> g").select(F.col("g").alias("u"), F.col("node").alias("v"))
    labels = components(verified(possible(stars).toDF("u", "v").unionByName(inner)), scratch)
    placed = scratch.write(members.join(labels, "node", "left").select("g", "node", F.coalesce("component", "node").alias("comp")), "placed")

    # second round: all pairs of one list whose groups are not yet in one component
    spans = scratch.write(placed.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")), "spans")
    spanned = scratch.write(shared.select("token", "g", "at").join(spans, "g"), "spanned")
    mixed = spanned.groupBy("token").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).filter("l < h").select("token")
    entries = scratch.write(spanned.join(mixed, "token").join(signs, "g").select("token", F.struct("g", "at", "lo", "hi").alias("e"), "sign"), "open")
    x, y = entries.toDF("token", "i", "x"), entries.toDF("token", "j", "y")
    apart = F.expr("i.g < j.g AND (i.lo <> i.hi OR j.lo <> j.hi OR i.lo <> j.lo)")
    fit = apart & _sizes_fit(F.col("x.n"), F.col("y.n"), percent) & _leads(F.col("i.at"), F.col("j.at"), F.col("x.n"), F.col("y.n"), percent) & _signs_fit("x", "y", percent)
    near = possible(x.join(y, "token").filter(fit).select(F.col("i.g").alias("a"), F.col("j.g").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).distinct())
    ends = placed.select("g", "node", "comp")
    split = placed.join(spans.filter("lo < hi").select("g"), "g", "left_semi")
    found = near.join(ends.toDF("a", "u", "cu"), "a").join(ends.toDF("b", "v", "cv"), "b").filter("cu <> cv").select("u", "v")
    links = verified(found.unionByName(split.toDF("g", "u", "cu").join(split.toDF("g", "v", "cv"), "g").filter("u < v AND cu <> cv").select("u", "v")))
    classes.destroy()
    label = placed.select("node", "comp")
    bridges = links.join(label.toDF("u", "cu"), "u").join(label.toDF("v", "cv"), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    top = components(bridges, scratch).toDF("comp", "top")
    placed = placed.join(top, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    final = placed.select("node", "comp")
    ids = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    comp = ids.join(final, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = scratch.write(comp.join(comp.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("node", "component_id"), "named")
    mine = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "node", F.col("n").alias("n_shingles"), "n", *extra).join(named, "node").select("doc_id", "n_shingles", mine.alias("component_id"), "node", *extra)


def keep_one(docs: DataFrame, decisions: DataFrame, key_sql: str, key_name: str, id_col: str = "doc_id") -> DataFrame:
    """Of each component the document with the least id stays, and those of null id in a component without ids. Rows that repeat id and text go or stay together."""
    a, b = spare(docs, "_id"), spare(docs, "_key")
    gone = decisions.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(a), F.col(key_name).alias(b)).distinct()
    own = spare(docs, "_own")
    keyed = docs.withColumn(own, F.expr(key_sql))
    return keyed.join(gone, keyed[id_col].cast("long").eqNullSafe(gone[a]) & (keyed[own] == gone[b]), "left_anti").select(*docs.columns)
