"""Operator 3: exact dedup against a persistent digest index (DataFrame functions only).

The index is a table bucketed and sorted by digest, one row per distinct text ever kept. New data
is reduced to a row per digest before any join, then anti-joined with the index (a sort-merge join
that reads the index without moving it), and what is new is appended under the name of its batch.

A batch may be run again, as after a lost driver: what the index holds under the batch's own name counts as new, so
that the decisions are those of the first run and nothing is added twice. Buckets are sized by the rows of the first
batch. Each append adds a file to a bucket; once buckets hold COMPACT_FILES the index is written anew, a file a
bucket, in a folder of its own that takes the place of the old one only when it is complete.

Texts are equal when identical after no change; null counts as empty. Of equal texts in one batch
the largest doc_id stays (null ids rank lowest); a text that the index holds already is dropped
whatever its id, unless it was this batch that brought it. Rows that repeat both id and text are counted each and
share one decision. An empty table gives an empty result. Texts are hashed whole in the JVM, whatever their length.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenstat.llm.shared import Scratch, delete, filled, shared_dir, spare

#: At most so many digests can each hold more than one in HOT_SHARE rows: the bound of the broadcast below.
HOT_SHARE = 1000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(filled(F.col(text_col)), 256).alias("text_sha256"))


#: Rows of the first batch to a bucket, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 4_000_000, 16
COMPACT_FILES = 8


class DigestIndex:
    """A persistent set of text digests under ``path``; ``name`` is its table in the catalog."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int | None = None) -> None:
        self.spark, self.name, self.buckets, self.kind = spark, name, buckets, "bigint"
        self.path = path or f"{shared_dir(spark)}/{name}"

    def _folders(self) -> list[str]:
        """Complete versions of the index, oldest first."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(conf)
        found = [x.getPath() for x in fs.listStatus(root)] if fs.exists(root) else []
        whole = [x for x in found if fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
        return sorted(f"{self.path}/{x.getName()}" for x in whole)

    def open(self, rows: int = 0, kind: str = "bigint") -> None:
        """Create the table for a first batch of ``rows`` with ids of type ``kind``, or attach it to files that an earlier session left at
        its path. A table that the catalog has, of this session or one before, is taken where it lies."""
        if self.spark.catalog.tableExists(self.name):
            self.folder = next(r["data_type"] for r in self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").collect() if r["col_name"] == "Location").rstrip("/")
            self.path, self.buckets = self.folder.rsplit("/", 1)[0], int(self.folder.rsplit("-", 1)[1])
            self.kind = self.table().schema["keep_id"].dataType.simpleString()
            return
        old = self._folders()
        self.kind = self.spark.read.parquet(old[-1]).schema["keep_id"].dataType.simpleString() if old else kind
        folder = old[-1] if old else f"{self.path}/v000000-{self.buckets or max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))}"
        self.buckets = int(folder.rsplit("-", 1)[1])  # the number of buckets is part of a folder's name
        self._attach(folder)

    def _attach(self, folder: str) -> None:
        self.folder = folder
        self.spark.sql(
            f"CREATE TABLE {self.name} (text_sha256 STRING, keep_id {self.kind}, group_size BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS LOCATION '{folder}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def _write(self, rows: DataFrame, name: str, folder: str, mode: str) -> None:
        rows.repartition(self.buckets, "text_sha256").write.mode(mode).format("parquet").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").option("path", folder).saveAsTable(name)

    def append(self, groups: DataFrame, batch: str) -> DataFrame:
        """Add the groups (a row per digest) that the index lacks; returns the index as it is then."""
        new = groups.select("text_sha256", "keep_id", "group_size", F.lit(batch).alias("batch")).join(self.table().select("text_sha256").hint("merge"), "text_sha256", "left_anti")
        self._write(new, self.name, self.folder, "append")
        self.spark.catalog.refreshTable(self.name)
        if len(self.table().inputFiles()) >= COMPACT_FILES * self.buckets:
            self.compact()
        return self.table()

    def compact(self) -> None:
        """Write the index anew, sorted, a file a bucket. A run that is lost midway leaves the old folder in place."""
        old = self.folder
        new = f"{self.path}/v{int(old.rsplit('/v', 1)[1].split('-')[0]) + 1:06d}-{self.buckets}"
        other = f"{self.name}_compact"
        self.spark.sql(f"DROP TABLE IF EXISTS {other}")
        delete(self.spark, new)
        self._write(self.table(), other, new, "errorifexists")
        self.spark.sql(f"DROP TABLE {other}")  # external tables: the files stay
        self.spark.sql(f"DROP TABLE {self.name}")
        self._attach(new)
        delete(self.spark, old)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def deduplicated(docs: DataFrame, index: DigestIndex, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """Decide every row of ``docs`` and add its new texts to ``index`` under the name ``batch`` (unnamed: one of its own, never to be run again).

    Returns a row per document: doc_id, keep_id, group_size, kept, text_sha256. ``group_size`` counts the
    rows of the batch that brought the text. A text may hold a third of all rows: groups are counted with
    partial aggregation, and the few digests with over a thousandth of the rows are looked up by a broadcast
    of at most HOT_SHARE rows instead of meeting in one task.
    """
    batch = batch or uuid.uuid4().hex
    rows = scratch.write(digests(docs, id_col, text_col), "digests")
    groups = scratch.write(rows.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    total, distinct = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0)), F.count("*")).first()
    index.open(distinct, rows.schema["doc_id"].dataType.simpleString())
    known = index.table().filter(F.col("batch") != batch).select("text_sha256").hint("merge")
    seen = scratch.write(groups.join(known, "text_sha256", "left_semi").select("text_sha256"), "known")
    index.append(groups, batch)
    least = total // HOT_SHARE + 1
    hot = F.broadcast(groups.filter(F.col("group_size") > least).join(seen.withColumn("known", F.lit(True)), "text_sha256", "left"))
    cold = groups.filter(F.col("group_size") <= least).join(seen.withColumn("known", F.lit(True)), "text_sha256", "left")
    is_hot = F.broadcast(groups.filter(F.col("group_size") > least).select("text_sha256"))
    out = rows.join(hot, "text_sha256").unionByName(rows.join(is_hot, "text_sha256", "left_anti").join(cold, "text_sha256"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("known").isNull() & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")


def keep_first_copies(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``decisions`` keeps, one for each text, with their columns as they are.

    Texts move once: rows meet the kept pairs of digest and id, so that a text that many rows share is spread by its ids.
    Only where rows repeat both id and text are those few taken apart, and one of each stays."""
    digest, key, more = spare(docs, "_digest"), spare(docs, "_key"), spare(docs, "_more")
    pairs = decisions.filter("kept").groupBy(F.col("text_sha256").alias(digest), F.col("doc_id").alias(key)).agg((F.count("*") > 1).alias(more))
    marked = docs.withColumn(f"{digest}_own", F.sha2(filled(F.col(text_col)), 256))
    kept = marked.join(pairs, (marked[f"{digest}_own"] == pairs[digest]) & marked[id_col].eqNullSafe(pairs[key]))
    if pairs.filter(more).isEmpty():
        return kept.select(*docs.columns)
    return kept.filter(~F.col(more)).select(*docs.columns).unionByName(kept.filter(more).dropDuplicates([digest]).select(*docs.columns))
