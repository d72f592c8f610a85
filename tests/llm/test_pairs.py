"""MinHash near duplicates, hard negatives and spelling variants against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from lumenstat.llm import minhash, negatives, queries, variants
from lumenstat.llm.shared import Scratch, table

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 700}" for i in range(30_000))
DOCS = "doc_id long, text string, lang string, node string, key int, n int"


def by_hand(rows, width, percent):
    """(doc_id, n, component) of (doc_id, text) rows."""
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def family(rng, n, size=60, edits=4):
    """Copies of one text, each with some words changed."""
    base = [f"b{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_minhash_components_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \t ", "One two", "one two", LONG, LONG + " end", "a b c d e", "A B C D E"]
    for size, edits in ((60, 4), (25, 2), (200, 12), (80, 3)):
        texts += family(rng, 25, size, edits)
    chain = [f"c{i}" for i in range(120)]
    texts += [" ".join(chain[i : i + 100]) for i in range(0, 20, 3)]  # each near the next, the ends are not near
    rows = [(7 * i, t) for i, t in enumerate(texts)] + [(None, texts[20]), (None, "alone and without an id here"), (21, "one two"), (21, "one two")]
    df = spark.createDataFrame([(d, t, "x", "y", 1, 2) for d, t in rows], DOCS)
    got = minhash.joined(df, Scratch(spark)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == by_hand(rows, 5, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.joined(spark.createDataFrame([], DOCS), Scratch(spark)).count() == 0


def test_minhash_rounds_leave_the_rest_to_pairs(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, t) for i, t in enumerate(family(rng, 40, 50, 5))]
    monkeypatch.setattr(minhash, "ROUNDS", 0)
    got = minhash.joined(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == by_hand(rows, 5, 85)


def test_minhash_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 2000).astype(np.uint64)
    sets = [np.unique(x[:1000]), np.unique(x[80:1080]), np.unique(x[600:1600])]
    least = minhash.minima(sets)
    near, far = (least[:, 0] == least[:, 1]).mean(), (least[:, 0] == least[:, 2]).mean()
    assert abs(near - 920 / 1080) < 0.12 and abs(far - 400 / 1600) < 0.15
    sign = minhash.signature(least).view(np.uint64)
    apart = [int(np.bitwise_count(sign[0] ^ sign[k]).sum()) for k in (1, 2)]
    assert apart[0] <= minhash.most_apart(85) < apart[1]


def mined_by_hand(rows, every=100):
    v = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in vec]) for i, vec, label in rows if None not in (i, vec, label) and all(x is not None and math.isfinite(x) for x in vec)]
    out = []
    for a, (i, label, e) in enumerate(v):
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(e, f, strict=True)), j, other) for b, (j, other, f) in enumerate(v) if b != a]
        for p, pid, _ in sorted(s for s in scored if s[2] == label)[:5]:
            fit = sorted(s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p)[:10]
            out += [(i, pid, r + 1, s[1], -p, -s[0]) for r, s in enumerate(fit)]
    return sorted(out)


VECS = "vec_id long, embedding array<double>, label int, row int, block string"


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0.3, 1, 6).round(2).tolist(), int(rng.integers(0, 3))) for i in range(700)]
    rows += [(100, rows[100][1], 1), (100, rows[5][1], 2), (7, rows[7][1], 0), (800, None, 1), (900, [1.0] * 6, None), (1000, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (1100, [float("nan")] * 6, 1), (1200, [float("inf")] * 6, 1)]
    rows += [(1300, [0.0] * 6, 2), (None, [1.0] * 6, 1)]
    df = spark.createDataFrame([(i, v, k, 1, "b") for i, v, k in rows], VECS)
    want = mined_by_hand(rows)
    for block in (8192, 100):
        monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
        monkeypatch.setattr(negatives, "ANCHOR_ROWS", 2048 if block > 100 else 3)
        assert sorted(map(tuple, negatives.mined(df, Scratch(spark)).collect())) == want
    assert negatives.mined(spark.createDataFrame([], VECS), Scratch(spark)).count() == 0


def test_hard_negatives_of_large_components_and_other_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(0.3, 1, 4) * 1e6).tolist(), i % 3) for i in range(120)]
    df = spark.createDataFrame([*rows, (200, [1.0, 2.0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, negatives.mined(df, Scratch(spark), every=20).collect())) == mined_by_hand(rows, 20)


def test_hard_negative_bounds_hold():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(3000, 10)))
    book = negatives.Quantiser(10).fit(x[:1000])
    code, residual = book.coded(x)
    low, high = book.bounds(x[:50], code, residual, np.sqrt((x**2).sum(1)))
    true = x[:50] @ x.T
    assert (low <= true).all() and (true <= high).all() and (high - low).mean() < np.abs(true).max()


def test_hard_negatives_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(queries.oracle_sql()["op12_hard_negatives"]).fetchall()
    assert want and sorted(map(tuple, queries.op12_hard_negatives(spark, SF).collect())) == sorted(want)


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def words_by_hand(rows):
    n = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if distance_one(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(((-n[v], v) for v in vs), default=None)
        form[w] = best[1] if best and -best[0] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def spelled(seed, n):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdéÀ") for _ in range(rng.randrange(4, 9))) for _ in range(30)]
    out = []
    for i in range(n):
        line = []
        for _ in range(60):
            w = list(rng.choice(stems[: 1 + int(30 * rng.random() ** 2)]))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = rng.choice(["", "a", "B", "é"])
            line.append("".join(w))
        out.append((i, rng.choice([" ", ", ", "-", "9"]).join(line)))
    return out


@pytest.mark.parametrize("shard,part", [(variants.SHARD_CHARS, variants.PART_CHARS), (700, 300)])
def test_variants_equal_brute_force(spark, shard, part):
    rows = spelled(9, 120) + [(None, "Hällo hällo hallo HALLO hallo hallo hallo hallo"), (500, None), (501, ""), (7, "abcde abcde abcde"), (7, "abcde abcde abcde"), (502, ("x" * 30_000 + " ") * 3), (503, "ABCDE日ABCDE Ünïcode ünïcode Ünïcode Ünïcode")]
    df = spark.createDataFrame([(d, t, "x", "y", 1, 2) for d, t in rows], DOCS)
    got = [tuple(r) for r in variants.grouped(df, Scratch(spark), shard_chars=shard, part_chars=part).collect()]
    want = words_by_hand(rows)
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 100 and any(w[2] not in (w[0], w[1]) for w in want)


def test_variants_of_tables(spark):
    assert variants.grouped(spark.createDataFrame([], DOCS), Scratch(spark)).count() == 0
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op13_spelling(spark, SF).collect()]
    assert sorted(got, key=str) == sorted(words_by_hand(rows), key=str)
