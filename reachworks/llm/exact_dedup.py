"""Exact de-duplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. New documents are reduced to digests, grouped with a
map-side combine, anti-joined with the index by sort-merge on the bucketed side, and what is new is appended.
Texts never leave the scan: only 32-byte digests and ids are shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachworks.session import freeze, shared_folder

SCHEMA = "digest binary, keep_id bigint, batch string"
BUCKETS = 64  # of a new index; an index keeps the number it was made with


def normalised(text: Column | str) -> Column:
    """Null is empty; each run of space and characters 9 to 13 becomes one space."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(col, F.lit("")), r"[\x20\x09-\x0D]+", " ")


class DigestIndex:
    """A digest -> keep_id table that outlives the session: open it again by its path.

    Every row names the batch that brought it. A batch that is sent again, after a failure or by mistake, finds its own
    digests unseen and adds only those that are still missing, so it gives the same rows as the first time.
    The number of buckets is stored beside the table; opening it with another one is refused.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path
        stored = self._stored()
        if stored is not None and buckets not in (None, stored):
            raise ValueError(f"{path} has {stored} buckets, not {buckets}; compact() it into another path")
        self.buckets = stored or buckets or BUCKETS
        if stored is None:
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).coalesce(1).write.parquet(f"{path}-buckets")
        self.table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({SCHEMA}) USING parquet CLUSTERED BY (digest) "
                  f"SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'")

    def _stored(self) -> int | None:
        try:
            return self.spark.read.schema("buckets int").parquet(f"{self.path}-buckets").first()["buckets"]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def read(self) -> DataFrame:
        """The bucketed table: joins on digest need no shuffle of this side."""
        return self.spark.table(self.table)

    def unseen(self, groups: DataFrame, batch: str | None = None) -> DataFrame:
        """The groups whose digest no other batch has brought."""
        known = self.read() if batch is None else self.read().where(F.col("batch") != batch)
        return groups.join(known.hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add what this batch has not added yet."""
        mine = self.read().where(F.col("batch") == batch)
        rows = groups if mine.isEmpty() else groups.join(mine.hint("merge"), "digest", "left_anti")
        self._write(rows.select("digest", "keep_id", F.lit(batch).alias("batch")))

    def _write(self, rows: DataFrame) -> None:
        (rows.repartition(self.buckets, "digest").sortWithinPartitions("digest")
         .write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
         .option("path", self.path).saveAsTable(self.table))
        self.spark.catalog.refreshTable(self.table)

    def compact(self, path: str, buckets: int | None = None) -> DigestIndex:
        """The same rows at a new path, one sorted file a bucket, with as many buckets as the index has grown to need."""
        out = DigestIndex(self.spark, path, buckets or self.buckets)
        out._write(self.plain())
        return out

    def plain(self) -> DataFrame:
        """The same rows without bucketing, for joins in which the other side has hot digests to split."""
        return self.spark.read.schema(SCHEMA).parquet(self.path)


def exact_groups(docs: DataFrame, index: DigestIndex, doc_id: str = "doc_id", text: str = "text", batch: str | None = None) -> DataFrame:
    """One row per input row: doc_id, digest, keep_id, group_size, kept; new digests are appended to the index.

    A job that may be run again passes a `batch` of its own: the same batch gives the same rows however often it comes.

    `keep_id` is the id already in the index, or else the smallest id of the batch (ids sort before null); then
    exactly one row of the group is kept, also if the id itself repeats. A null text is empty, and empty texts are
    one group. `group_size` counts the rows of the batch. An empty input gives no rows and leaves the index alone.
    """
    members = freeze(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.unhex(F.sha2(normalised(text), 256)).alias("digest"),
                                 F.monotonically_increasing_id().alias("row_tag")))
    groups = freeze(members.groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_tag")).alias("first"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row_tag").alias("first_tag"), "group_size"))
    batch = batch or uuid.uuid4().hex
    fresh = freeze(index.unseen(groups, batch))
    index.append(fresh, batch)
    # Read without buckets, so that both sides are plain shuffles whose hot digests the runtime can split.
    known = groups.drop("keep_id", "first_tag").join(index.plain().drop("batch"), "digest")
    resolved = freeze(known.join(fresh.select("digest", "first_tag"), "digest", "left"))
    return members.join(resolved, "digest").select(
        "doc_id", "digest", "row_tag", "keep_id", "group_size", F.coalesce(F.col("row_tag") == F.col("first_tag"), F.lit(False)).alias("kept"))


def exact_dedup(docs: DataFrame, index: DigestIndex, doc_id: str = "doc_id", text: str = "text", batch: str | None = None) -> DataFrame:
    """The documents whose text the index had not seen, one of each group, with all their columns.

    Of rows that repeat both id and text one stays. Ids of one row, the usual case, are met by id alone; only rows
    whose id repeats are compared by digest as well.
    """
    groups = freeze(exact_groups(docs, index, doc_id, text, batch))
    rows = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    once = freeze(rows.where("n = 1 and kept").select("doc_id"))
    often = freeze(groups.where("kept").join(rows.where("n > 1").select(F.col("doc_id").alias("o")), F.col("doc_id").eqNullSafe(F.col("o")))
                   .select(F.col("doc_id"), "digest"))
    key = F.col(f"d.{doc_id}").cast("bigint").eqNullSafe(F.col("k.doc_id"))
    # One way at every size: texts are dealt by id once and never sorted.
    plain = docs.alias("d").join(once.hint("shuffle_hash").alias("k"), key, "left_semi")
    again = (docs.withColumn("__digest", F.unhex(F.sha2(normalised(text), 256))).alias("d")
             .join(often.alias("k"), key & (F.col("d.__digest") == F.col("k.digest")), "left_semi")
             .dropDuplicates([doc_id, "__digest"]).drop("__digest"))
    return plain.unionByName(again)


def scratch_index(spark: SparkSession) -> DigestIndex:
    """A new, empty index in the cluster's shared folder."""
    return DigestIndex(spark, f"{shared_folder(spark)}/digest-index-{uuid.uuid4().hex}")
