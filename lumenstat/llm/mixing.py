"""Operator 7: mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies of each of its documents. The whole part is
taken for certain; the fraction is rounded by the pivotal method: two open documents exchange words at
random until one of them is settled, so that the source's words stay as they are in every exchange.
A group of documents leaves at most one open; what groups leave open meets in the next level of a
reduction tree. At the root one document at most is settled by chance alone, so a source's words
miss its target by less than one document.

Null texts and texts without words have size 0 and are taken 0 words. Null is a source of its own,
last in order. Rows that repeat are documents of their own. An empty table gives an empty result.
The random numbers are seeded by source, level and group, and groups are formed by hash of id and text:
reruns agree however the rows are dealt. Rows without an id are told apart by their texts. One row per source meets on the driver, as a catalogue.
Texts are only counted and hashed, in the JVM, whatever their length. Ids and carried columns pass through unchanged.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenstat.llm.shared import Scratch, filled, spare

MOST = 3  # copies of a document at most
GROUP = 4096  # documents settled together, as an aim
FAN = 64  # groups that meet in the next level
EPS = 1e-9


def targets(sizes: list[tuple[str | None, int]], most: float = MOST, weights: tuple[int, ...] = (1, 2, 3)) -> list[tuple[str | None, int, float]]:
    """(source, size, target) for (source, size): weights repeat by code point order, null last; what a cap cuts goes to the others."""
    order = sorted(sizes, key=lambda x: (x[0] is None, [ord(c) for c in x[0] or ""]))
    weight = [weights[i % len(weights)] for i in range(len(order))]
    total, capped = sum(n for _, n in order), {}
    while True:
        left = total - sum(capped.values())
        share = sum(w for i, w in enumerate(weight) if i not in capped)
        over = {i: most * order[i][1] for i, w in enumerate(weight) if i not in capped and left * w > most * order[i][1] * share}
        if not over:
            break
        capped |= over
    return [(s, n, float(capped[i]) if i in capped else left * weight[i] / share) for i, (s, n) in enumerate(order)]


def pivotal(sizes: list[int], parts: list[float], rng: random.Random) -> tuple[list[float], int]:
    """Round ``parts`` (in [0, 1]) to 0 or 1 but for one, keeping the sum of size times part. Returns them and the place of the open one, -1 if none."""
    out, held = list(parts), -1
    for i, (n, p) in enumerate(zip(sizes, out, strict=True)):
        if n <= 0 or p <= EPS or p >= 1 - EPS:
            out[i] = float(round(p)) if n > 0 else 0.0
            continue
        if held < 0:
            held = i
            continue
        m, q = sizes[held], out[held]
        up, down = min((1 - p) * n, q * m), min(p * n, (1 - q) * m)
        move = up if rng.random() * (up + down) < down else -down
        p, q = p + move / n, q - move / m
        for k, x in ((i, p), (held, q)):
            out[k] = 0.0 if x <= EPS else 1.0 if x >= 1 - EPS else x
        held = next((k for k in (held, i) if 0 < out[k] < 1), -1)
    return out, held


def _settle(level: int) -> Callable[[pa.Table], pa.Table]:
    """Rounds the rows of each (src, grp) of a table; the other columns, ids among them, stay in Arrow as they are."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("src", "grp", "key", "size", "grp0", "own")])
        src, grp, size, part = (t[c].to_pylist() for c in ("src", "grp", "size", "part"))
        done: list[float] = []
        still: list[bool] = []
        for (s, g), rows in itertools.groupby(range(t.num_rows), key=lambda i: (src[i], grp[i])):
            own = list(rows)
            rng = random.Random(hashlib.blake2b(f"{s!r}|{level}|{g}".encode(), digest_size=8).digest())
            found, held = pivotal([size[i] for i in own], [part[i] for i in own], rng)
            done += found
            still += [i == held for i in range(len(own))]
        for name, values in (("part", pa.array(done, pa.float64())), ("open", pa.array(still, pa.bool_()))):
            t = t.set_column(t.column_names.index(name), name, values)
        return t

    return run


def _settled(rows: DataFrame, level: int, tasks: int) -> DataFrame:
    """Groups meet by a hash of source and group, so that many small sources share a task's call."""
    at = spare(rows, "_at")
    dealt = rows.withColumn(at, F.pmod(F.xxhash64("src", "grp", F.lit(level)), F.lit(tasks)))
    return dealt.groupBy(at).applyInArrow(_settle(level), dealt.schema).drop(at)


def mixed(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken, copies, and the columns of ``carry`` (SQL, name) pairs."""
    text = filled(F.col(text_col))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("src"),
        F.size(F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")).cast("long").alias("size"), F.xxhash64(text).alias("own"), *[F.expr(sql).alias(name) for sql, name in carry],
    )
    rows = scratch.write(rows, "sizes")
    stats = rows.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).collect()
    plan = targets([(r["src"], r["source_size"]) for r in stats])
    n_docs = {r["src"]: r["n"] for r in stats}
    table = scratch.spark.createDataFrame([(s, n, t, max(1, math.ceil(n_docs[s] / GROUP)), t / n if n else 0.0) for s, n, t in plan], "s string, source_size long, target double, groups long, rate double")
    joined = rows.join(table, F.col("src").eqNullSafe(F.col("s")), "inner").drop("s")
    whole = F.floor(F.col("rate") + EPS)
    extra = [name for _, name in carry]
    joined = joined.withColumns({
        "whole": whole.cast("long"), "part": F.greatest(F.col("rate") - whole, F.lit(0.0)), "key": F.coalesce(F.col("doc_id"), F.lit(-1)),
        "grp0": F.pmod(F.xxhash64("doc_id", "own"), F.col("groups")), "open": F.lit(False),
    }).withColumn("grp", F.col("grp0"))
    out = scratch.write(_settled(joined, 0, max(1, math.ceil(sum(n_docs.values()) / GROUP))), "level0")
    waiting = out.filter("open").select("src", "size", "own", "key", "grp0", "grp", "part", "open")
    level, most = 0, max([1, *(r.groups for r in table.select("groups").collect())])
    while most > 1:
        level, most = level + 1, math.ceil(most / FAN)
        waiting = waiting.withColumn("grp", F.floor(F.col("grp") / FAN))
        done = scratch.write(_settled(waiting, level, max(1, math.ceil(sum(n_docs.values()) / GROUP / FAN**level))), f"level{level}")
        late = done.filter("NOT open") if level == 1 else late.unionByName(done.filter("NOT open"))
        waiting = done.filter("open")
    chance = F.pmod(F.xxhash64("src", "key", "own"), F.lit(1 << 30)) / float(1 << 30)
    waiting = waiting.withColumn("part", F.when(chance < F.col("part"), 1.0).otherwise(0.0))
    settled = waiting if level == 0 else late.unionByName(waiting)
    settled = settled.select(F.col("src").alias("s"), F.col("grp0").alias("g"), F.col("part").alias("late"))
    both = out.join(settled, F.col("open") & F.col("src").eqNullSafe(F.col("s")) & (F.col("grp0") == F.col("g")), "left")
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + F.coalesce(F.col("late"), F.col("part")).cast("long"))
    return both.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("long").alias("copies"), *extra)


def repeated(docs: DataFrame, decisions: DataFrame, key_sql: str, key_name: str, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with every row as often as ``decisions`` (doc_id, key, copies) says; rows that repeat both id and key all get the largest count among them."""
    a, b, c = (spare(docs, x) for x in ("_id", "_key", "_copies"))
    d = decisions.filter("copies > 0").groupBy(F.col("doc_id").alias(a), F.col(key_name).alias(b)).agg(F.max("copies").cast("int").alias(c))
    keyed = docs.withColumn(spare(docs, "_own"), F.expr(key_sql))
    joined = keyed.join(d, keyed[id_col].cast("long").eqNullSafe(d[a]) & (keyed[spare(docs, "_own")] == d[b]), "inner")
    return joined.withColumn(c, F.explode(F.sequence(F.lit(1), F.col(c)))).select(*docs.columns)
