"""Operator 2: log-bilinear language model with noise-contrastive training.

A-Z is lower-cased; tokens are runs outside space and bytes 9 to 13, then one end, counted as a token.
Word counts come from every training document: they are summed by 64-bit word hash in a shuffle that
grows with the corpus. The WORDS most frequent words (of LEAST or more) and the end have vectors of their own, as
context and as target; a word beyond them is one of KINDS units, by its last two bytes.

Words are dealt to classes of equal mass, in order of frequency. Context vectors, weighted for each distance, are
added up to a prediction h. A token's class is scored by the product of h with the class's vector, plus a bias, and
normalised over all classes and kinds; then the word by the product of h with its own vector, plus a bias, normalised
over its class. A word of a kind has its add-one share of the kind's counts, so that probabilities over all words, and
one unknown in each kind, add up to 1. Both normalisations are batched matrix products.

Training contrasts each token's class, and its word within the class, with noise drawn from their frequencies and
leaves scores unnormalised. Documents are dealt by hash to shards of about SHARD tokens, read in order of id within
each. Each round trains on its share of the shards, every shard from the same start, and takes the mean by tokens,
summed in order up a tree: the result is that of the rows, however they are dealt over files and partitions.

Null and empty texts have the end alone. Null ids count as the empty text in the split. Repeated rows
are scored each. Words of equal count are taken by hash. Without training documents all counts are 0; an empty table
gives an empty result. The model has at most 0.6 million numbers, a shard's tokens take 2 bytes each, and the driver
holds the model and the counts of KNOWN words, at any size of the corpus. A text is tokenised in one task's memory,
at some 60 bytes a byte of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstat.llm.shared import Scratch, as_bytes, filled, mapped, pieces
from lumenstat.llm.words import Batch, mix

WORDS, LEAST = 16_384, 8  # words of their own at most, and the count from which on
CLASSES, KINDS = 96, 64  # of those words, and of the others
CONTEXT, DIM = 4, 16
BATCH, NOISE, INNER = 4096, 32, 4  # tokens of a step; noise classes of a step, and noise words of each class
RATE = 0.08
ROUNDS, SHARD = 2, 1 << 22
FAN, BLOCK = 64, 1 << 9  # shards added up together; numbers of the model in a row
KNOWN = 1 << 17  # most frequent words, scored where the text is; the rest by a join
END = np.uint64(0x0E0D0E0D0E0D0E0D)


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 7 == 2


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, kind and text of every token, ends included."""
    b = Batch(texts)
    one = b.buf[b.end - 1].astype(np.int64)
    two = np.where(b.end - b.start > 1, b.buf[np.maximum(b.end - 2, 0)], 0).astype(np.int64)
    at = b.bounds()[1:]  # an end after the last word of each text
    kind = (mix((one << 8 | two).astype(np.uint64)) % np.uint64(KINDS)).astype(np.int64)
    return np.insert(b.hashes(), at, END), np.insert(kind, at, 0), np.insert(b.doc, at, np.arange(b.n_docs))


def vocabulary(docs: DataFrame) -> DataFrame:
    """h, kind, c: tokens of all ``docs`` (column text) by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            h, k = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            u, first, c = np.unique(h, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(k[first].astype(np.int32)), pa.array(c.astype(np.int64))], ["h", "kind", "c"])

        n = 0
        for b in batches:
            texts = as_bytes(b.column(0))
            for lo, hi in pieces([len(t) for t in texts]):
                h, k, _ = tokens(texts[lo:hi])
                held.append((h, k))
                n += len(h)
                if n > 3_000_000:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    return mapped(docs.select("text"), run, "h bigint, kind int, c bigint").groupBy("h").agg(F.first("kind").alias("kind"), F.sum("c").alias("c"))


def summed(at: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different places of ``at``, and the sum of the rows of ``grad`` at each."""
    order = np.argsort(at.astype(np.uint16), kind="stable")  # a radix sort; there are fewer units than 65,536
    own = at[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    return own[first], np.add.reduceat(grad[order], first, axis=0) if len(first) else grad[:0]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Parameters, and what is known of the training counts: of the words ``top`` (hashes), then of the kinds."""

    def __init__(self, top: list[int], unit_counts: np.ndarray) -> None:
        order = np.argsort(np.array(top, np.int64).view(np.uint64), kind="stable")
        self.top, self.top_unit = np.array(top, np.int64).view(np.uint64)[order], order
        self.words, n = len(top), len(unit_counts)
        mass = np.asarray(unit_counts, float) + 0.5
        words, kinds = mass[: self.words], mass[self.words :]
        before = np.cumsum(words) - words  # a class takes the words that begin in its share of the mass
        cls = np.minimum((before * CLASSES / max(words.sum(), 1e-9)).astype(np.int64), CLASSES - 1)
        _, self.first, cls = np.unique(cls, return_index=True, return_inverse=True)
        self.n_classes = len(self.first)
        self.last = np.append(self.first[1:], self.words).astype(np.int64)
        own = np.array([words[a:b].sum() for a, b in zip(self.first, self.last, strict=True)])
        self.of = np.concatenate([cls, self.n_classes + np.arange(n - self.words)]).astype(np.int64)  # class, or kind after all classes, of each unit
        p = np.concatenate([own, kinds]) / mass.sum()
        self.log_class, self.class_edges = np.log(p).astype(np.float32), np.cumsum(p)
        self.log_word = np.log(words / own[cls]).astype(np.float32) if self.words else np.zeros(0, np.float32)
        self.word_edges = np.cumsum(words)
        rng = np.random.default_rng(11)
        draw = lambda rows: (0.1 * rng.standard_normal((rows, DIM))).astype(np.float32)
        # context vectors, weights of distances, and vectors of classes and words with their bias
        self.params = {"r": draw(n), "c": np.full((CONTEXT, DIM), 0.5, np.float32), "q": np.hstack([draw(len(p)), self.log_class[:, None]]), "w": np.hstack([draw(self.words), self.log_word[:, None]])}

    def units(self, h: np.ndarray, kind: np.ndarray) -> np.ndarray:
        if not len(self.top):
            return self.words + kind
        at = np.minimum(np.searchsorted(self.top, h), len(self.top) - 1)
        return np.where(self.top[at] == h, self.top_unit[at], self.words + kind)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.params[k].ravel() for k in sorted(self.params)])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.params):
            n = self.params[k].size
            self.params[k] = flat[at : at + n].reshape(self.params[k].shape).astype(np.float32)
            at += n

    def context(self, units: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """(tokens, distances): the unit so far before each token, or the number of units (a zero vector) before the text's start."""
        out = np.full((len(units), CONTEXT), len(self.of))
        for d in range(1, CONTEXT + 1):
            same = doc[d:] == doc[:-d]
            out[d:, d - 1][same] = units[:-d][same]
        return out

    def train(self, units: np.ndarray, doc: np.ndarray, rng: np.random.Generator, past: dict[str, np.ndarray]) -> None:
        """One pass of noise-contrastive steps with adaptive rates; ``past`` holds squared gradients."""
        p, sizes = self.params, self.last - self.first
        shift = np.log(NOISE) + self.log_class
        inner_shift = np.log(INNER) + self.log_word
        low = np.append(0.0, self.word_edges)[self.first] if self.n_classes else np.zeros(0)
        room = self.word_edges[self.last - 1] - low if self.n_classes else np.zeros(0)
        r = np.vstack([p["r"], np.zeros((1, DIM), np.float32)])
        past_r = np.vstack([past["r"], np.zeros((1, DIM), np.float32)])
        q, w, dist = p["q"], p["w"], p["c"]

        def step(x: np.ndarray, squares: np.ndarray, rows: np.ndarray | slice, g: np.ndarray) -> None:
            total = squares[rows] + g * g
            squares[rows] = total
            x[rows] -= RATE * g / np.sqrt(total + 1.0)

        for lo in range(0, len(units), BATCH):
            from_ = max(lo - CONTEXT, 0)
            u = units[from_ : lo + BATCH].astype(np.int64)
            near, u = self.context(u, doc[from_ : lo + BATCH])[lo - from_ :], u[lo - from_ :]
            y = self.of[u]
            seen = r[near]
            h = np.ones((len(u), DIM + 1), np.float32)
            np.einsum("bcd,cd->bd", seen, dist, out=h[:, :DIM])
            # the class among noise classes
            k = np.minimum(np.searchsorted(self.class_edges, rng.random(NOISE)), len(shift) - 1)
            qy, qk = q[y], q[k]
            g_true = _logistic(np.einsum("bd,bd->b", h, qy) - shift[y]) - 1  # d loss / d score of the class
            g_false = _logistic(h @ qk.T - shift[k])  # and of each noise class
            qy *= g_true[:, None]
            g_h = qy + g_false @ qk
            at, g = summed(np.concatenate([y, k]), np.concatenate([g_true[:, None] * h, g_false.T @ h]))
            step(q, past["q"], at, g)
            # the word among noise words of its class
            own = np.flatnonzero(u < self.words)
            own = own[sizes[y[own]] > 1]
            if len(own):
                own = own[np.argsort(y[own].astype(np.uint16), kind="stable")]
                word, c, hw = u[own], y[own], h[own]
                some = np.flatnonzero(np.diff(c, prepend=-1))  # where the classes of this step begin
                kinds = c[some]
                z = np.searchsorted(self.word_edges, low[kinds, None] + room[kinds, None] * rng.random((len(kinds), INNER)), "right")
                z = np.minimum(z, self.last[kinds, None] - 1)
                which = np.repeat(np.arange(len(kinds)), np.diff(np.append(some, len(c))))
                wy, wz = w[word], w[z][which]
                g_true = _logistic(np.einsum("bd,bd->b", hw, wy) - inner_shift[word]) - 1
                g_false = _logistic(np.einsum("bd,bkd->bk", hw, wz) - inner_shift[z][which])
                wy *= g_true[:, None]
                wy += np.einsum("bk,bkd->bd", g_false, wz)
                g_h[own] += wy
                far = np.add.reduceat(g_false[:, :, None] * hw[:, None, :], some, axis=0)
                at, g = summed(np.concatenate([word, z.ravel()]), np.concatenate([g_true[:, None] * hw, far.reshape(-1, DIM + 1)]))
                step(w, past["w"], at, g)
            g_h = g_h[:, :DIM]
            at, g = summed(near.ravel(), (dist[None] * g_h[:, None, :]).reshape(-1, DIM))
            step(dist, past["c"], slice(None), np.einsum("bcd,bd->cd", seen, g_h))
            keep = at < len(self.of)
            step(r, past_r, at[keep], g[keep])
        p["r"], past["r"] = r[:-1], past_r[:-1]

    def log10(self, units: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each token's unit."""
        before, out, p = self.context(units, doc), np.empty(len(units)), self.params
        r = np.vstack([p["r"], np.zeros((1, DIM), np.float32)])
        r = [r * p["c"][d] for d in range(CONTEXT)]
        qt = np.ascontiguousarray(p["q"].T)
        for lo in range(0, len(units), 8 * BATCH):
            u = units[lo : lo + 8 * BATCH]
            near, y = before[lo : lo + 8 * BATCH], self.of[u]
            h = np.ones((len(u), DIM + 1), np.float32)
            h[:, :DIM] = r[0][near[:, 0]]
            for d in range(1, CONTEXT):
                h[:, :DIM] += r[d][near[:, d]]
            mine = np.empty(len(u))
            for a in range(0, len(u), BATCH // 2):
                mine[a : a + BATCH // 2] = _log_share(h[a : a + BATCH // 2] @ qt, y[a : a + BATCH // 2])
            order = np.argsort(y.astype(np.uint16), kind="stable")
            cut = np.searchsorted(y[order], np.arange(self.n_classes + 1))
            for k in np.flatnonzero((np.diff(cut) > 0) & (self.last - self.first > 1)):
                a, b, rows = self.first[k], self.last[k], order[cut[k] : cut[k + 1]]
                mine[rows] += _log_share(h[rows] @ p["w"][a:b].T, u[rows] - a)
            out[lo : lo + 8 * BATCH] = mine
        return out / np.log(10)


def _log_share(s: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Logarithm of the normalised share of column ``own`` in each row of scores."""
    mine = s[np.arange(len(s)), own].astype(float)
    total = np.exp(s) @ np.ones(s.shape[1], np.float32)
    far = np.flatnonzero(~((total > 1e-25) & (total < 1e25)))  # too small or large for this precision
    if len(far):
        top = s[far].max(1)
        total = total.astype(float)
        total[far] = np.exp(top.astype(float)) * np.exp(s[far] - top[:, None]).sum(1)
    return mine - np.log(total)


def trained(units: DataFrame, model: Model, scratch: Scratch, shards: int) -> Model:
    """Train on every row of ``units`` (shard, key, own, units): in each round every one of its shards from the same start, then their mean by tokens."""

    names = ["block", "part", "x", "n"]

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come shard by shard, in order of id; one shard is held at a time."""
        shard, lists = -1, []

        def done() -> Iterator[pa.RecordBatch]:
            m: Model = start.value
            first, flat = m.flat(), np.concatenate([x for part in lists for x in part])
            doc = np.repeat(np.arange(sum(map(len, lists)), dtype=np.int32), [len(x) for part in lists for x in part])
            lists.clear()
            m.train(flat, doc, np.random.default_rng([5, shard]), {k: np.zeros_like(x) for k, x in m.params.items()})
            x = m.flat()
            m.load(first)  # the broadcast object is reused by this worker
            cut = range(0, len(x), BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array([shard // ROUNDS] * len(cut), pa.int64()), pa.array([(x[lo : lo + BLOCK] * np.float64(len(flat))).tobytes() for lo in cut], pa.binary()), pa.array([len(flat)] * len(cut), pa.int64())], names)

        for b in batches:
            of, cut = b.column(0).to_numpy(), b.column(1).offsets.to_numpy()
            flat = b.column(1).values.to_numpy()
            for i in range(len(of)):
                if of[i] != shard:
                    if lists:
                        yield from done()
                    shard = int(of[i])
                if not lists or len(lists[-1]) >= 4096:
                    lists.append([])
                lists[-1].append(flat[cut[i] : cut[i + 1]].copy())
        if lists:
            yield from done()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of rows that come by block and upper part, in order of part."""
        at, x, n = None, np.zeros(0), 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int64()), pa.array([x.tobytes()], pa.binary()), pa.array([n], pa.int64())], names)

        for b in batches:
            for block, part, one, k in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (block, part // FAN) != at:
                    if at is not None:
                        yield row()
                    at, x, n = (block, part // FAN), np.zeros(len(one) // 8), 0
                x, n = x + np.frombuffer(one, float), n + k
        if at is not None:
            yield row()

    schema = "block int, part bigint, x binary, n bigint"
    for k in range(ROUNDS):
        start = units.sparkSession.sparkContext.broadcast(model)
        rows = units.filter(F.col("shard") % ROUNDS == k).repartition("shard").sortWithinPartitions("shard", "key", "own")
        sums, left = scratch.write(mapped(rows.select("shard", "units"), train, schema), "parts"), -(-shards // ROUNDS)
        while True:
            up = sums.withColumn("up", F.floor(F.col("part") / FAN)).repartition("block", "up").sortWithinPartitions("block", "up", "part")
            sums, left = mapped(up.select(*names), add, schema), -(-left // FAN)
            if left <= 1:
                break
            sums = scratch.write(sums, "parts")
        found = sorted(sums.collect(), key=lambda row: row["block"])
        start.destroy()
        if found:
            model.load(np.concatenate([np.frombuffer(row["x"], float) / row["n"] for row in found]))
    return model


def scored(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    sc, end = scratch.spark.sparkContext, int(END.view(np.int64))
    text = filled(F.col(text_col))
    docs = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), text.alias("text"), F.xxhash64(id_col).alias("key"), F.xxhash64(text).alias("own"))
    words = scratch.write(vocabulary(docs.filter(~F.col("held_out"))), "words")
    n_all, v_all = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    known = words.orderBy(F.desc("c"), "h").limit(KNOWN).select("h", "c").toArrow()
    hashes, counts = known["h"].to_numpy(), known["c"].to_numpy()
    top = [h for h in hashes[: WORDS - 1][counts[: WORDS - 1] >= LEAST].tolist() if h != end] + [end]
    of = dict(zip(hashes.tolist(), counts.tolist(), strict=True))
    kinds = words.join(F.broadcast(scratch.spark.createDataFrame([(h,) for h in top], "h long")), "h", "left_anti").groupBy("kind").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # at most WORDS rows
    kind_c, kind_v = np.zeros(KINDS), np.zeros(KINDS)
    for row in kinds:
        kind_c[row["kind"]], kind_v[row["kind"]] = row["c"], row["v"]
    model = Model(top, np.concatenate([[of.get(h, 0) for h in top], kind_c]))
    shards = ROUNDS * max(1, -(-int(n_all) // (SHARD * ROUNDS)))
    order = np.argsort(hashes.view(np.uint64))
    unit_of = np.full(len(hashes), -1)
    unit_of[np.isin(hashes, np.array(top, np.int64))] = 0
    unit_of = np.where(unit_of == 0, model.units(hashes.view(np.uint64), np.zeros(len(hashes), np.int64)), -1)[order]
    sent = sc.broadcast((model.words, hashes.view(np.uint64)[order], unit_of, np.log10(counts[order] + 1.0), np.log10(kind_c + kind_v + 1)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_words, known_h, known_u, logs, room = sent.value
        for b in batches:
            texts = as_bytes(b.column(2))
            for lo, hi in pieces([len(t) for t in texts]):
                h, kind, doc = tokens(texts[lo:hi])
                u, n = n_words + kind, hi - lo
                if len(known_h):
                    at = np.minimum(np.searchsorted(known_h, h), len(known_h) - 1)
                    found = known_h[at] == h
                    log_c = np.where(found, logs[at], 0.0)
                    u = np.where(found & (known_u[at] >= 0), known_u[at], u)
                else:  # no training text: the end is the only word
                    found, log_c, u = np.zeros(len(h), bool), np.zeros(len(h)), np.where(h == END, 0, u)
                inside = np.where(u >= n_words, log_c - room[kind], 0.0)
                late, late_doc = h[~found].view(np.int64), doc[~found]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(late_doc, minlength=n))])
                sums = [np.bincount(doc, w, minlength=n) for w in (np.ones(len(doc)), found, log_c, inside)]
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, kind)) for at, x, kind in ((ends, u.astype(np.int16), pa.int16()), (offsets, late, pa.int64()))]
                cols = [b.column(k).slice(lo, n) for k in (0, 1, 3, 4)]
                cols += [pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(sums[3]), *lists]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "key", "own", "n_tokens", "n_known", "logs", "inside", "units", "late"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = mapped(docs, read, f"doc_id {kind}, held_out boolean, key bigint, own bigint, n_tokens bigint, n_known bigint, logs double, inside double, units array<smallint>, late array<bigint>")
    rows = rows.withColumns({"uid": F.monotonically_increasing_id(), "shard": F.pmod(F.xxhash64("key", "own"), F.lit(shards)).cast("int")})
    rows = scratch.write(rows, "units")
    final = sc.broadcast(trained(rows.filter(~F.col("held_out")), model, scratch, shards))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, lists, out = b.column(3).to_numpy(), b.column(7), []
            for lo, hi in pieces(sizes.tolist(), 1 << 16):
                flat = lists.slice(lo, hi - lo).flatten().to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(hi - lo), sizes[lo:hi])
                out.append(np.bincount(doc, final.value.log10(flat, doc), minlength=hi - lo))
            if out:
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(6)], pa.array(np.concatenate(out) + b.column(6).to_numpy())], ["uid", "doc_id", "held_out", "n_tokens", "n_known", "logs", "score"])

    late = rows.select("uid", F.explode("late").alias("h")).groupBy("uid", "h").count()
    late = late.join(words.select("h", "c"), "h").groupBy("uid").agg(F.sum("count").alias("more"), F.sum(F.col("count") * F.log10(F.col("c") + 1.0)).alias("more_logs"))
    done = mapped(rows.select("uid", "doc_id", "held_out", "n_tokens", "n_known", "logs", "inside", "units"), score, f"uid bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, logs double, score double")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return done.join(late, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("more")).cast("long").alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("logs") + zero("more_logs") - F.col("n_tokens") * F.lit(float(np.log10(n_all + v_all + 1)))).alias("base_score"),
        (F.col("score") + zero("more_logs")).alias("score"),
    )
