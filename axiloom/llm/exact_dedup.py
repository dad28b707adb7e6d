"""Exact dedup against a persistent digest index, bucketed and sorted by hash.

Texts are equal when identical after lower-casing A-Z only; null counts as empty. The index is a table of one row per
known digest, stored in hash buckets and sorted inside them, so that a later batch joins it without a shuffle of the
index. A batch is reduced to its distinct digests, deduplicated against the index by a sort-merge anti-join, and what
is new is appended. The distinct digests are written before they meet the index: the optimizer would else move the
anti-join below their aggregation, and each row of a hot digest would be shuffled to one task.

Defined results: of equal texts in one batch the row with the largest doc_id stays (a null doc_id only if the group has
no other); rows that repeat a doc_id and its text share one verdict; texts known from an earlier batch are not kept and
point to the row that stayed then, with the group size of the batch that brought them; a batch that is run again under
its name gets the same answers; an empty batch gives no rows; texts may be of any length, as only digests move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axiloom.llm.common import ROW, fresh_path, lower_az, materialize, release, with_row_key


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as lowercase hex."""
    return F.sha2(lower_az(F.coalesce(text, F.lit(""))), 256)


class DigestIndex:
    """A digest index at ``path``; opened if it is there, else created with ``buckets`` buckets."""

    SCHEMA = "digest STRING, keep_id BIGINT, n BIGINT, batch STRING"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = "digest_index_" + hashlib.md5(path.encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({self.SCHEMA}) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def append(self, groups: DataFrame, batch: str) -> None:
        """Append the groups (digest, keep_id, n), one of each digest and read from files, whose digest the index lacks."""
        known = self.spark.table(self.name).select("digest")
        fresh = groups.select("digest", "keep_id", "n").join(known.hint("merge"), "digest", "left_anti")
        fresh.withColumn("batch", F.lit(batch)).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def entries(self) -> DataFrame:
        """The index as plain files, without its bucketing: joins with it can then be split where a digest is hot."""
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def forget(self) -> None:
        """Take the index out of the session's catalog. Its files stay, and opening it again finds them."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def distinct_digests(digests: DataFrame, *more: Column) -> DataFrame:
    """One row of each digest: keep_id, n and ``more``, combined in every task before anything is shuffled."""
    return digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"), *more)


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str = "first", carry: Sequence[str] = ()) -> DataFrame:
    """Deduplicate the batch ``docs`` against itself and the index, and append what is new.

    Returns doc_id, keep_id, group_size, kept, text_sha256 and the columns ``carry`` for each row. Only digests move:
    texts are read once, where they lie. Rows meet their verdict in a join of two shuffled sides, which adaptive
    execution splits where a group of copies is large.
    """
    own = index or DigestIndex(docs.sparkSession, fresh_path(docs.sparkSession, "digest-index"))
    digests = materialize(docs.select("doc_id", *carry, text_digest(F.col("text")).alias("digest")), "digests")
    groups = materialize(distinct_digests(digests), "groups")
    own.append(groups, batch)
    release(groups)
    if index is None:
        own.forget()
    found = digests.join(own.entries().hint("merge"), "digest")
    kept = (F.col("batch") == batch) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return found.select("doc_id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), F.col("digest").alias("text_sha256"), *carry)


def drop_copies(docs: DataFrame, index: DigestIndex | None = None, batch: str = "first") -> DataFrame:
    """One document of each group of equal texts that the index lacks, all columns as they are: the row that
    exact_dedup() keeps, and of several with its doc_id and text one. Rows are told apart by a key, as a doc_id may be
    null or repeated. An empty table gives an empty one."""
    rows = with_row_key(docs, "exact-rows")
    own = index or DigestIndex(docs.sparkSession, fresh_path(docs.sparkSession, "digest-index"))
    first = F.max(F.struct("doc_id", *ROW))
    groups = materialize(distinct_digests(rows.select("doc_id", *ROW, text_digest(F.col("text")).alias("digest")), first.alias("first")), "groups")
    own.append(groups, batch)
    if index is None:
        own.forget()
    new = own.entries().where(F.col("batch") == batch).select("digest")
    stay = groups.join(new.hint("merge"), "digest", "left_semi").select(*[F.col(f"first.{c}").alias(c) for c in ROW])
    return rows.join(stay.hint("merge"), list(ROW), "left_semi").select(*docs.columns)
