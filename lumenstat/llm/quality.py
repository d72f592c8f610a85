"""Operator 8: quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words, all of them encoded: shares of byte classes and marks,
word lengths, capitals and repetition. A hidden layer, gated attention over the passages and a logistic
output are trained together on document labels, by Adam in numpy; the weighted passage
representation gives the score. Labels come from rows outside the held-out fold only, in a bounded
sample (LOW_ROWS and HIGH_ROWS rows, by hash of the id, and of these as many as have FIT_PASSAGES passages together,
some 40 MB on the driver); every document is scored, by all its passages.

Null and empty texts are one passage of zeros. Without labels of both kinds, and so for empty tables, every score is
0.5. Null ids count as the empty text in the split. Rows that repeat are scored each; of rows that repeat an id the
text of least hash teaches. A text's passages are held in one task's memory, at some 60 bytes a byte of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenstat.llm.shared import Scratch, as_bytes, filled, mapped, pieces
from lumenstat.llm.words import Batch

PASSAGE = 64
LOW_ROWS, HIGH_ROWS = 2500, 7500
FIT_PASSAGES = 200_000
HIDDEN, GATE = 16, 8
GOOD = 0.3

_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS = np.zeros(256, np.int64)
_CLASS[[*range(ord("a"), ord("z") + 1)]] = 1
_CLASS[[*range(ord("A"), ord("Z") + 1)]] = 2
_CLASS[[*range(ord("0"), ord("9") + 1)]] = 3
_CLASS[128:] = 4
_CLASS[[9, 10, 11, 12, 13]] = 5
_CLASS[_MARKS] = 6 + np.arange(len(_MARKS))
N_CLASSES = 6 + len(_MARKS)
N_FEATURES = N_CLASSES + 7


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 == 0


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the number of passages of each text (one at least)."""
    b = Batch(texts, lower=False)
    count, bounds = b.counts(), b.bounds()
    n_pass = np.maximum(1, -(-count // PASSAGE))
    base = np.concatenate([[0], np.cumsum(n_pass)])
    p = base[b.doc] + (np.arange(len(b.doc)) - bounds[b.doc]) // PASSAGE  # passage of each word
    total = int(base[-1])
    words = np.maximum(np.bincount(p, minlength=total), 1)
    # bytes belong to the passage of the last word that starts before them
    starts = np.zeros(len(b.buf), np.int64)
    starts[b.start] = 1
    of_word = np.cumsum(starts) - 1
    inside = of_word >= 0
    cell = np.bincount(p[of_word[inside]] * N_CLASSES + _CLASS[b.buf[inside]], minlength=total * N_CLASSES).reshape(total, N_CLASSES)
    share = cell / np.maximum(cell.sum(1, keepdims=True), 1)
    h, length = b.hashes(), b.end - b.start

    def rate(flag: np.ndarray) -> np.ndarray:
        return np.bincount(p, flag, minlength=total) / words

    same = np.zeros((3, len(h)))
    for d in (1, 2, 3):
        same[d - 1][d:] = (h[d:] == h[:-d]) & (p[d:] == p[:-d])
    more = [rate(same[0]), rate(same.max(0)), rate(length) / 10, rate(length == 1), rate(_CLASS[b.buf[b.start]] == 2), rate(_CLASS[b.buf[b.end - 1]] > 5), np.bincount(p, minlength=total) / PASSAGE]
    return np.hstack([np.sqrt(share), np.stack(more, 1)]).astype(np.float32), n_pass


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class AttentionModel:
    """Hidden layer, gated attention and output."""

    def __init__(self) -> None:
        rng = np.random.default_rng(13)

        def draw(*shape: int) -> np.ndarray:
            return rng.standard_normal(shape) / np.sqrt(shape[0])

        self.mean, self.scale, self.ready = np.zeros(N_FEATURES), np.ones(N_FEATURES), False
        self.p = {"w": draw(N_FEATURES, HIDDEN), "wb": np.zeros(HIDDEN), "v": draw(HIDDEN, GATE), "u": draw(HIDDEN, GATE), "a": draw(GATE), "o": draw(HIDDEN), "ob": np.zeros(1)}

    def forward(self, x: np.ndarray, n: np.ndarray) -> tuple:
        p, first = self.p, np.concatenate([[0], np.cumsum(n)[:-1]])
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        z = np.tanh(x @ p["w"] + p["wb"])
        t, g = np.tanh(z @ p["v"]), _sigmoid(z @ p["u"])
        e = (t * g) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), n))
        att = e / np.repeat(np.add.reduceat(e, first), n)
        bag = np.add.reduceat(att[:, None] * z, first, axis=0)
        return x, z, t, g, att, bag, _sigmoid(bag @ p["o"] + p["ob"]), first

    def score(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.forward(x, n)[6] if self.ready else np.full(len(n), 0.5)

    def gradients(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x, z, t, g, att, bag, out, first = self.forward(x, n)
        d = (out - y) / len(y)
        d_bag = np.repeat(d[:, None] * p["o"], n, axis=0)
        d_att = (d_bag * z).sum(1)
        d_e = att * (d_att - np.repeat(np.add.reduceat(att * d_att, first), n))
        d_tg = d_e[:, None] * p["a"]
        d_t, d_g = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
        d_z = (att[:, None] * d_bag + d_t @ p["v"].T + d_g @ p["u"].T) * (1 - z * z)
        return {"w": x.T @ d_z, "wb": d_z.sum(0), "v": z.T @ d_t, "u": z.T @ d_g, "a": (t * g).T @ d_e, "o": bag.T @ d, "ob": np.array([d.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.004) -> AttentionModel:
        if not y.any() or y.all():
            return self
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 0.02
        rng = np.random.default_rng(17)
        m, v, k = {a: 0.0 for a in self.p}, {a: 0.0 for a in self.p}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for lo in range(0, len(order), batch):
                some = order[lo : lo + batch]
                k += 1
                for a, g in self.gradients(np.concatenate([bags[i] for i in some]), np.array([len(bags[i]) for i in some]), y[some]).items():
                    g = g + (1e-4 * self.p[a] if a in "wvuo" else 0)
                    m[a], v[a] = 0.9 * m[a] + 0.1 * g, 0.999 * v[a] + 0.001 * g * g
                    self.p[a] = self.p[a] - rate * (1 - epoch / epochs) * (m[a] / (1 - 0.9**k)) / (np.sqrt(v[a] / (1 - 0.999**k)) + 1e-8)
        self.ready = True
        return self


def fitted(docs: DataFrame, labels: DataFrame) -> AttentionModel:
    """``docs``: doc_id, text; ``labels``: doc_id, quality."""
    kind, scratch = docs.schema["doc_id"].dataType.simpleString(), Scratch(docs.sparkSession)
    labels = labels.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marked = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    by_hash = F.xxhash64("doc_id", F.lit(21))
    picked = marked.filter("quality = 0").orderBy(by_hash, "doc_id").limit(LOW_ROWS).unionByName(marked.filter("quality = 1").orderBy(by_hash, "doc_id").limit(HIGH_ROWS))
    found = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "quality")  # at most LOW_ROWS + HIGH_ROWS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(1))
            for lo, hi in pieces([len(t) for t in texts]):
                x, n = passages(texts[lo:hi])
                cut = np.concatenate([[0], np.cumsum(n)])
                rows = [x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(rows, pa.binary()), pa.array(n.astype(np.int64))], ["doc_id", "quality", "x", "n"])

    once = Window.partitionBy("doc_id").orderBy(F.xxhash64("x"))
    rows = mapped(found, run, f"doc_id {kind}, quality int, x binary, n bigint").withColumn("k", F.row_number().over(once)).filter("k = 1").drop("k")
    rows = scratch.write(rows, "passages")
    sizes, total, taken = rows.select("doc_id", "n").orderBy(by_hash, "doc_id").collect(), 0, []  # a row for each sampled label
    for r in sizes:
        if total + r["n"] <= FIT_PASSAGES:
            total += r["n"]
            taken.append((r["doc_id"],))
    if not taken:
        scratch.close()
        return AttentionModel()
    own = F.broadcast(docs.sparkSession.createDataFrame(taken, f"doc_id {kind}"))
    got = rows.join(own, "doc_id", "left_semi").orderBy("doc_id").select("quality", "x").toArrow()
    scratch.close()
    return AttentionModel().fit([np.frombuffer(x.as_buffer(), np.float32).reshape(-1, N_FEATURES) for x in got["x"]], got["quality"].to_numpy().astype(float))


def scored(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(2))
            for lo, hi in pieces([len(t) for t in texts]):
                s = sent.value.score(*passages(texts[lo:hi]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(s), pa.array((s >= GOOD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), filled(F.col("text")).alias("text")), run, f"doc_id {kind}, held_out boolean, score double, predicted int")
