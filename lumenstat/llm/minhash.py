"""Operator 11: near duplicates by MinHash.

A document is the set of its distinct word shingles (A-Z lower-cased; shorter texts: the whole sequence as one; no
words: empty, linked with nothing). Documents of equal sets are one node. HASHES universal hashes, a x + b modulo 2**64
with a odd, give a node its minima; each band of BAND minima is one key, and nodes that share a key are candidates. For
a similarity s two nodes share no key with probability (1 - s**BAND)**(HASHES/BAND): 6e-11 at 0.85, 2e-8 at 0.8.

Candidates must fit in size, and their signatures (four bits of each minimum) must not differ in more bits than a pair
of the least similarity does but for APART standard deviations. A second signature holds the parity of the set's shingles
in each of PARITY cells: two differ in no more bits than the sets differ in shingles, so that a pair that fails cannot
link. Those that remain are confirmed on whole sets.

Links are found in rounds, so that a large group of near copies never becomes all its pairs. In each round a key's
nodes meet the key's hub, the node of least hash among them, the same for all keys of a round, and each node tries the
least hub that its signature allows; components by alternating large-star and small-star then join what is linked. At
last all pairs of one key that are still in different components are tried. So components are those of all links, while
links inside a component need not be spelled out.

What meets on the driver is a bitmap of the documents whose whole sets are wanted: of fixed most size, a hashed filter
that a join makes exact. A text's shingles are held in one task's memory, at some 60 bytes a word.

Null texts count as empty; null ids take no part in the least id, and a row without an id is kept where no row of its
component has one. Rows that repeat are one node; all rows of the least id are kept. Extra columns are ignored. An empty
table gives an empty result. Equal similarity is no tie here: all links count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstat.llm.components import components
from lumenstat.llm.jaccard import MASK_BITS, _links_enough, _mask, _sizes_fit
from lumenstat.llm.shared import Scratch, as_bytes, filled, mapped, pieces
from lumenstat.llm.words import Batch, mix, shingles

HASHES, BAND = 128, 4
BITS = 4  # of each minimum, in the signature
APART = 6  # standard deviations that a linked pair's signatures may lie beyond their mean
PARITY = 512  # cells, a multiple of 64
ROUNDS = 3  # of hubs, before the pairs that are left

_rng = np.random.default_rng(11)
_A = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**64 - 1, HASHES, dtype=np.uint64)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(HASHES, sets) least values of the universal hashes over each of ``sets``, none of them empty."""
    x = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out, room = np.empty((HASHES, len(sets)), np.uint64), np.empty_like(x)
    for j in range(HASHES):
        np.multiply(x, _A[j], out=room)
        np.add(room, _B[j], out=room)
        np.minimum.reduceat(room, starts, out=out[j])
    return out


def bands(least: np.ndarray) -> np.ndarray:
    """(sets, bands) keys."""
    grouped = least.reshape(HASHES // BAND, BAND, -1)
    key = np.arange(1, HASHES // BAND + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    for j in range(BAND):
        key = mix(key ^ grouped[:, j])
    return key.T.view(np.int64)


def signature(least: np.ndarray) -> np.ndarray:
    """(sets, words) BITS bits of each minimum, packed."""
    low = (mix(least) & np.uint64((1 << BITS) - 1)).T.reshape(least.shape[1], -1, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(2, dtype=np.uint64).view(np.int64)


def parity(found: np.ndarray) -> np.ndarray:
    """Whether each cell holds an odd number of the shingles, packed."""
    odd = np.bincount((found & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_key(found: np.ndarray) -> np.int64:
    """A hash of a whole set; 0 for the empty one."""
    return np.int64(0) if not len(found) else mix(np.bitwise_xor.reduce(mix(found ^ np.uint64(0x5BD1E995)))[None] + found.sum(dtype=np.uint64)).view(np.int64)[0]


def most_apart(percent: int) -> int:
    """Bits in which the signatures of a linked pair may differ."""
    differ = 1 - percent / 100
    mean, square = differ * BITS / 2, differ * (BITS + BITS**2) / 4
    return int(HASHES * mean + APART * (HASHES * (square - mean**2)) ** 0.5) + 1


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(np.ascontiguousarray(rows).ravel(), pa.int64()))


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, node, n, keys, bits, odd of every row of ``docs`` (doc_id, text); empty sets have no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(1))
            for lo, hi in pieces([len(t) for t in texts]):
                sets = shingles(Batch(texts[lo:hi]), width)
                size = np.array([len(s) for s in sets])
                some = np.flatnonzero(size)
                keys, bits, odd = (np.zeros((hi - lo, k), np.int64) for k in (HASHES // BAND, HASHES * BITS // 64, PARITY // 64))
                if len(some):
                    least = minima([sets[i] for i in some])
                    keys[some], bits[some], odd[some] = bands(least), signature(least), np.stack([parity(sets[i]) for i in some])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([set_key(s) for s in sets], pa.int64()), pa.array(size, pa.int64()), _lists(keys), _lists(bits), _lists(odd)], ["doc_id", "node", "n", "keys", "bits", "odd"])

    return mapped(docs, run, "doc_id bigint, node bigint, n bigint, keys array<bigint>, bits array<bigint>, odd array<bigint>")


def _whole_sets(docs: DataFrame, width: int, mask: object, mask_bits: int) -> DataFrame:
    """node, tokens of the documents whose ids ``mask`` may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(mask.value, np.uint8)
        for b in batches:
            at = b.column(0).fill_null(-1).to_numpy(zero_copy_only=False) & ((1 << mask_bits) - 1)
            texts = as_bytes(b.column(1).filter(pa.array((wanted[at >> 3] >> (at & 7) & 1).astype(bool))))
            for lo, hi in pieces([len(t) for t in texts]):
                sets = shingles(Batch(texts[lo:hi]), width)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets).view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), tokens], ["node", "tokens"])

    return mapped(docs, run, "node bigint, tokens array<bigint>")


def _signs_fit(x: str, y: str, percent: int) -> Column:
    def apart(name: str, words: int) -> Column:
        return sum((F.bit_count(F.col(f"{x}.{name}")[k].bitwiseXOR(F.col(f"{y}.{name}")[k])) for k in range(words)), F.lit(0))

    a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
    need = F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent) - 1e-9)  # shingles that linked sets of these sizes share
    return _sizes_fit(a, b, percent) & (apart("bits", HASHES * BITS // 64) <= most_apart(percent)) & (a + b - apart("odd", PARITY // 64) >= 2 * need)


def joined(docs: DataFrame, scratch: Scratch, width: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (the least doc_id reachable by links), kept."""
    sc = scratch.spark.sparkContext
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), filled(F.col(text_col)).alias("text"))
    rows = scratch.write(signed(docs, width), "rows")
    nodes = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits"), F.first("odd").alias("odd"))
    nodes = scratch.write(nodes, "nodes")
    entries = nodes.select("node", F.explode("keys").alias("key"))
    shared = scratch.write(entries.join(entries.groupBy("key").count().filter("count > 1").select("key"), "key"), "shared")
    ends = scratch.write(nodes.join(shared.select("node").distinct(), "node").select("node", "doc_id", F.struct("n", "bits", "odd").alias("sign")), "ends")
    signs = ends.select("node", "sign")
    mask_bits = min(max(ends.count().bit_length() + 6, MASK_BITS[0]), MASK_BITS[1])

    def verified(pairs: DataFrame) -> DataFrame:
        """Of distinct node pairs (u, v), those that link, by whole sets."""
        pairs = scratch.write(pairs, "pairs")
        used = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
        wanted = scratch.write(ends.join(used, "node").select("node", "doc_id"), "wanted")
        mask = sc.broadcast(_mask(wanted, mask_bits))
        full = scratch.write(_whole_sets(docs, width, mask, mask_bits).join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "full")
        a, b = full.toDF("u", "tu"), full.toDF("v", "tv")
        enough = _links_enough(F.size(F.array_intersect("tu", "tv")), F.size("tu"), F.size("tv"), percent)
        out = scratch.write(pairs.join(a, "u").join(b, "v").filter(enough).select("u", "v"), "links")
        scratch.drop(full)
        mask.destroy()
        return out

    def merged(placed: DataFrame, links: DataFrame) -> DataFrame:
        """``placed`` (node, comp) with components that ``links`` join made one."""
        across = links.join(placed.toDF("u", "cu"), "u").join(placed.toDF("v", "cv"), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
        found = components(across, scratch).toDF("comp", "top")
        return scratch.write(placed.join(found, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), "placed")

    def still_open(placed: DataFrame) -> DataFrame:
        """key, node, comp of the keys whose nodes are in several components."""
        here = shared.join(placed, "node")
        split = here.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
        return scratch.write(here.join(split, "key").select("key", "node", "comp"), "open")

    placed = signs.select("node", F.col("node").alias("comp"))
    for k in range(ROUNDS):
        left = still_open(placed)
        order = F.xxhash64("node", F.lit(k))
        hubs = left.groupBy("key").agg(F.min(F.struct(order.alias("pick"), F.col("node").alias("hub"), F.col("comp").alias("hub_comp"))).alias("h")).select("key", "h.*")
        tries = left.join(hubs, "key").filter("comp <> hub_comp").select("node", "hub", "pick").distinct()
        tries = tries.join(signs.toDF("node", "x"), "node").join(signs.toDF("hub", "y"), "hub").filter(_signs_fit("x", "y", percent))
        first = tries.groupBy("node").agg(F.min(F.struct("pick", "hub")).alias("h")).select(F.least("node", "h.hub").alias("u"), F.greatest("node", "h.hub").alias("v")).distinct()
        placed = merged(placed, verified(first))

    left = still_open(placed)
    signed_left = left.join(signs, "node").select("key", F.struct("node", "comp").alias("e"), "sign")
    x, y = signed_left.toDF("key", "i", "x"), signed_left.toDF("key", "j", "y")
    rest = x.join(y, "key").filter(F.expr("i.node < j.node AND i.comp <> j.comp") & _signs_fit("x", "y", percent))
    placed = merged(placed, verified(rest.select(F.col("i.node").alias("u"), F.col("j.node").alias("v")).distinct()))

    ids = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(placed, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = ids.join(ids.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("node", "component_id")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = rows.select("doc_id", "node", "n").join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
