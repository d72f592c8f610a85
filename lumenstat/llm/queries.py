"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenstat.llm import bpe, exact, jaccard, language, minhash, mixing, nearest, negatives, personal, pieces, quality, toxicity, variants
from lumenstat.llm.shared import Scratch, table

#: Where the public tokenizers' files are; any path can be given instead.
TOKENIZERS = os.path.dirname(public_tokenizers.path("word_bpe_49k.json"))


def op1_bpe(spark: SparkSession, sf_dir: str, path: str = f"{TOKENIZERS}/word_bpe_49k.json") -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), path)


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return scratch.finish(language.scored(table(spark, sf_dir, "documents"), scratch))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    index = exact.DigestIndex(spark, f"digests_{uuid.uuid4().hex}")
    out = scratch.finish(exact.deduplicated(table(spark, sf_dir, "documents"), index, scratch, batch="documents"))
    index.drop()
    return out


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.found(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str, path: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    return pieces.counted(table(spark, sf_dir, "documents"), path)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.with_scores(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return scratch.finish(mixing.mixed(table(spark, sf_dir, "documents"), scratch))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.scored(docs, quality.fitted(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return scratch.finish(nearest.neighbours(vectors, vectors.filter("vec_id % 50 = 0"), scratch))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    found = jaccard.joined(table(spark, sf_dir, "documents"), scratch)
    return scratch.finish(found.select("doc_id", "n_shingles", "component_id"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return scratch.finish(minhash.joined(table(spark, sf_dir, "documents"), scratch))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return scratch.finish(negatives.mined(table(spark, sf_dir, "embeddings"), scratch))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return scratch.finish(variants.grouped(table(spark, sf_dir, "documents"), scratch))


def _near_copies(width: int, percent: int, last: str) -> str:
    """Components of all links by whole sets of shingles; ``last``: further columns of the result."""
    return f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws
            FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - {width - 2}), lambda i: array_to_string(ws[i:i + {width - 1}], ' ')) END) AS sh
            FROM w),
        e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
        o AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
        l AS (SELECT x, y FROM o UNION SELECT y, x FROM o),
        r AS (SELECT doc_id AS x, doc_id AS c FROM s UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.x WHERE r.c < l.y)
        SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m.c AS component_id{last}
        FROM s JOIN (SELECT x, min(c) AS c FROM r GROUP BY x) m ON m.x = s.doc_id"""


_ORACLES = {
    "op11_minhash": _near_copies(5, 85, ", s.doc_id = m.c AS kept"),
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
        n AS (
            SELECT p.anchor_id, p.other AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
                s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
            FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, d.text_sha256
        FROM d JOIN g ON d.text_sha256 = g.text_sha256""",
    "op10_jaccard": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws
            FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh
            FROM w),
        e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
        o AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        l AS (SELECT x, y FROM o UNION SELECT y, x FROM o),
        r AS (SELECT doc_id AS x, doc_id AS c FROM s UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.x WHERE r.c < l.y)
        SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m.c AS component_id
        FROM s JOIN (SELECT x, min(c) AS c FROM r GROUP BY x) m ON m.x = s.doc_id""",
}


def queries() -> dict:
    return {f.__name__: f for f in (op1_bpe, op2_language_model, op3_exact_dedup, op4_personal_data, op5_token_counts, op6_toxicity, op7_mixing, op8_quality, op9_nearest, op10_jaccard, op11_minhash, op12_hard_negatives, op13_spelling)}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
