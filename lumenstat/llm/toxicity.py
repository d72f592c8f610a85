"""Operator 6: toxicity by a classifier chain.

Each category is one link of the chain: the kinds of toxic text that the labelled rows show, found by grouping
toxic documents by their telling features (spherical k-means from far-apart starts), and at last toxic at all. A link
is a logistic model on hashed words and word beginnings of the whole text and on the probabilities of the links
before it, which in training come from models of other folds.

Labels come from a bounded sample (TOXIC_ROWS and CLEAN_ROWS labelled rows, by hash of the id); every document is
scored. The FEATURES that tell the kinds apart best are counted and chosen on the executors; the driver gets those
and, for each sampled row, which of them it has: at most 8 * FEATURES bytes a row, however long its text.

Null and empty texts have no features and get the chain's base rate. Rows whose label is null or whose document is
missing teach nothing; without labels of both kinds, and so for empty tables, every document scores 0; where no feature
occurs in three labelled rows, every document scores the base rate. Rows that
repeat are scored each; of rows that repeat an id the text of least hash teaches. Equally telling features are taken
by hash. A document is rejected from a probability of 0.5. A text's features are held in one task's memory, at some
80 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenstat.llm.shared import Scratch, as_bytes, filled, mapped, pieces
from lumenstat.llm.words import Batch

TOXIC_ROWS, CLEAN_ROWS = 2500, 5000
FEATURES = 512  # those that differ most between the kinds
KINDS = 4  # groups of toxic documents, a category each
FOLDS = 3
BEGINS = (5,)  # bytes of a word's beginning
REJECT = 0.5


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs of whole texts; features are 64-bit hashes of words and beginnings."""
    b = Batch(texts, letters=True)
    h = np.concatenate([b.hashes(), *[b.hashes(b.start, np.minimum(b.start + k, b.end)) ^ np.uint64(k) for k in BEGINS]])
    doc = np.tile(b.doc, 1 + len(BEGINS))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x1: np.ndarray, y: np.ndarray, penalty: float = 0.3, steps: int = 120) -> np.ndarray:
    """Weights by accelerated gradient descent on the penalised log loss; the last column of ``x1`` is 1, for the bias."""
    w = np.zeros(x1.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    v = np.ones(x1.shape[1], x1.dtype)
    for _ in range(15):  # largest eigenvalue, for the step
        u = x1.T @ (x1 @ v)
        top = float(np.linalg.norm(u))
        v = (u / top).astype(x1.dtype)
    rate, at, before = 1 / (top / 4 + penalty), w.copy(), w
    for k in range(steps):
        g = x1.T @ (_sigmoid(x1 @ at.astype(x1.dtype)) - y).astype(x1.dtype)
        g = g.astype(float)
        g[:-1] += penalty * at[:-1]
        before, w = w, at - rate * g
        at = w + k / (k + 3) * (w - before)
    return w


def grouped(docs: list[np.ndarray], count: int = KINDS, rounds: int = 20) -> np.ndarray:
    """Groups of documents (sets of feature hashes) by cosine, from starts that are far apart; no random numbers."""
    names, at = np.unique(np.concatenate([*docs, np.empty(0, np.uint64)]), return_inverse=True)
    x = np.zeros((len(docs), len(names) + 1), np.float32)
    x[np.repeat(np.arange(len(docs)), [len(d) for d in docs]), at] = 1
    x[:, -1] = 1e-3  # a document without features has a direction too
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = [x[np.argmax(x @ x.mean(0))]]
    while len(centres) < min(count, len(docs)):
        centres.append(x[np.argmin(np.max(x @ np.stack(centres).T, axis=1))])
    c = np.stack(centres)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == k].mean(0) if (own == k).any() else c[k] for k in range(len(c))])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    return np.argmax(x @ c.T, axis=1)


class Chain:
    """Links in order: for each, weights of the features, of the links before it, and the bias."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.hashes, self.scale = np.empty(0, np.uint64), np.empty(0, np.float32)
        self.weights: list[np.ndarray] = []

    def fit(self, docs: list[np.ndarray], toxic: np.ndarray, names_of: list[str | None], folds: np.ndarray) -> Chain:
        """``docs``: each one's distinct feature hashes; ``names_of``: the category of each toxic one."""
        if not toxic.any() or toxic.all():
            return self
        h = np.concatenate(docs)
        row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        names, at = np.unique(h, return_inverse=True)
        pos = np.bincount(at[toxic[row] > 0], minlength=len(names)).astype(float)
        neg = np.bincount(at[toxic[row] == 0], minlength=len(names)).astype(float)
        n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
        p, q = (pos + 0.5) / (n1 + 1), (neg + 0.5) / (n0 + 1)
        z = np.abs(p - q) / np.sqrt(p * (1 - p) / n1 + q * (1 - q) / n0)
        z[pos + neg < 3] = 0
        best = np.sort(np.lexsort((names, -z))[:FEATURES])
        self.hashes = names[best]
        slot = np.full(len(names), -1)
        slot[best] = np.arange(len(best))
        kinds = sorted({k for k, t in zip(names_of, toxic, strict=True) if t and k is not None})
        targets = [(f"toxic_{k}", toxic * np.array([v == k for v in names_of])) for k in kinds] + [("toxic", toxic)]
        width = len(best)
        full = np.zeros((len(docs), width + len(targets)), np.float32)  # features, earlier links, and 1
        keep = slot[at] >= 0
        self.scale = np.abs(np.log(p[best] * (1 - q[best]) / (q[best] * (1 - p[best])))).astype(np.float32)  # what tells the kinds apart weighs more
        full[row[keep], slot[at[keep]]] = self.scale[slot[at[keep]]]
        for j, (name, y) in enumerate(targets):
            full[:, width + j] = 1
            seen = full[:, : width + j + 1]
            self.names.append(name)
            self.weights.append(logistic(seen, y))
            out = np.zeros(len(docs))
            for f in range(FOLDS):  # the next links learn from what this one says of rows it has not seen
                test = folds == f
                if test.any() and not test.all():
                    out[test] = _sigmoid(seen[test] @ logistic(seen[~test], y[~test]))
            full[:, width + j] = out
        return self

    def predict(self, doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
        """Probabilities, (texts, links), from distinct (text, feature) pairs."""
        if not self.names:
            return np.zeros((n, 1))
        if not len(self.hashes):  # no feature was seen often enough: the base rates are left
            doc, h = doc[:0], h[:0]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        ok = self.hashes[at] == h
        at, doc = at[ok], doc[ok]
        out = np.zeros((n, len(self.names)))
        k = len(self.hashes)
        for j, w in enumerate(self.weights):
            out[:, j] = _sigmoid(np.bincount(doc, (w[:k] * self.scale)[at], minlength=n) + out[:, :j] @ w[k : k + j] + w[-1])
        return out


def telling(rows: DataFrame, n1: int, n0: int) -> list[int]:
    """The hashes of the FEATURES whose shares among toxic and clean rows (toxic, h) differ most, by standard errors."""
    p, q = (F.col("pos") + 0.5) / (n1 + 1), (F.col("seen") - F.col("pos") + 0.5) / (n0 + 1)
    z = F.abs(p - q) / F.sqrt(p * (1 - p) / n1 + q * (1 - q) / n0)
    counts = rows.select("toxic", F.explode("h").alias("h")).groupBy("h").agg(F.sum("toxic").alias("pos"), F.count("*").alias("seen")).filter("seen >= 3")
    return [r["h"] for r in counts.orderBy(z.desc(), F.col("h") < 0, "h").limit(FEATURES).select("h").collect()]


def fitted(docs: DataFrame, labels: DataFrame) -> Chain:
    """``docs``: doc_id, text; ``labels``: doc_id, toxic."""
    kind, scratch = docs.schema["doc_id"].dataType.simpleString(), Scratch(docs.sparkSession)
    marked = labels.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = F.xxhash64("doc_id", F.lit(9))
    picked = marked.filter("toxic = 1").orderBy(by_hash, "doc_id").limit(TOXIC_ROWS).unionByName(marked.filter("toxic = 0").orderBy(by_hash, "doc_id").limit(CLEAN_ROWS))
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic")  # at most TOXIC_ROWS + CLEAN_ROWS ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(1))
            for lo, hi in pieces([len(t) for t in texts]):
                doc, h = features(texts[lo:hi])
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), lists], ["doc_id", "toxic", "h"])

    once = Window.partitionBy("doc_id").orderBy("own")
    rows = mapped(found, run, f"doc_id {kind}, toxic int, h array<bigint>").withColumn("own", F.xxhash64("h"))
    rows = scratch.write(rows.withColumn("k", F.row_number().over(once)).filter("k = 1").select("doc_id", "toxic", "h"), "features")
    n1, n = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if not n1 or n1 == n:
        scratch.close()
        return Chain()
    best = np.array(telling(rows, n1, n - n1), np.int64)
    order = np.sort(best)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [order[np.isin(order, h.values.to_numpy(zero_copy_only=False))].astype("<i8").tobytes() for h in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.binary()), b.column(2)], ["toxic", "h", "fold"])

    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    got = mapped(rows.orderBy("doc_id").select("toxic", "h", fold), chosen, "toxic int, h binary, fold int").toArrow()
    scratch.close()
    sets, toxic = [np.frombuffer(x, np.uint64) for x in got["h"].to_pylist()], got["toxic"].to_numpy().astype(float)
    names: list[str | None] = [None] * len(sets)
    at = np.flatnonzero(toxic)
    for i, k in zip(at, grouped([sets[i] for i in at]), strict=True):
        names[i] = f"kind_{k + 1}"
    return Chain().fit(sets, toxic, names, got["fold"].to_numpy())


def with_scores(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, score, toxic, categories (name, probability)."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Chain = sent.value
        names = c.names or ["toxic"]
        for b in batches:
            texts = as_bytes(b.column(1))
            for lo, hi in pieces([len(t) for t in texts]):
                p = c.predict(*features(texts[lo:hi]), hi - lo)
                entries = pa.StructArray.from_arrays([pa.array(names * len(p), pa.string()), pa.array(p.ravel())], ["name", "probability"])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * len(names), pa.int32()), entries)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(p[:, -1]), pa.array(p[:, -1] >= REJECT), lists], ["doc_id", "score", "toxic", "categories"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", filled(F.col(text_col)).alias("text")), run, f"doc_id {kind}, score double, toxic boolean, categories array<struct<name: string, probability: double>>")


def clean_only(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the chain does not reject, with all their columns, in one pass."""
    sent, at = docs.sparkSession.sparkContext.broadcast(chain), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(at))
            for lo, hi in pieces([len(t) for t in texts]):
                keep = sent.value.predict(*features(texts[lo:hi]), hi - lo)[:, -1] < REJECT
                if keep.any():
                    yield b.slice(lo, hi - lo).filter(pa.array(keep))

    return mapped(docs, run, docs.schema)
