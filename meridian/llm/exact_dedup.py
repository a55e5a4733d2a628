"""Exact deduplication against a persistent digest index.

The index is a table in the shared folder, partitioned by batch and bucketed and sorted by digest. A batch is reduced
to one row per digest and joined with the index by sort-merge: the index side is not shuffled, its buckets are only
sorted (a bucket has a file for each batch until ``compact``). Digests that the index does not know are those of the
anti-join; they and the counts of known ones are written as the batch's partition. A batch that is written again
replaces its own partition, so a run that was lost can be repeated and gives the same rows."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, materialize, scratch_path, unused

#: Fixed by the contract: the characters that do not count, [\x20\x09-\x0D].
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalized(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


class DigestIndex:
    """Rows (digest binary, owner boolean, keep_id long, n long) by batch: n rows of that batch have the digest, and the
    batch that brought it first is its owner and says which id stays. ``buckets`` is fixed when the table is made: by
    default as many as the session's shuffle partitions, 32 at least."""

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        if not spark.catalog.tableExists(self.name):
            n = buckets or max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
            spark.sql(
                f"CREATE TABLE {self.name} (digest BINARY, owner BOOLEAN, keep_id BIGINT, n BIGINT, batch STRING) USING parquet "
                f"PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {n} BUCKETS LOCATION '{path or scratch_path(spark, 'digest-index')}'"
            )
        # The table says how many buckets it has, whoever made it.
        rows = spark.sql(f"DESCRIBE EXTENDED {self.name}").filter("col_name = 'Num Buckets'").collect()
        self.buckets = int(rows[0]["data_type"])

    def batches(self) -> DataFrame:
        """All rows: of each batch its digests and their counts."""
        return self.spark.table(self.name)

    def table(self) -> DataFrame:
        """One row for each digest known, of the batch that brought it."""
        return self.batches().filter("owner")

    def write(self, rows: DataFrame, batch: str) -> None:
        """Replace the batch's rows; one file per bucket."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError("a batch is named by letters, digits and _ . -")
        dealt = rows.repartition(self.buckets, "digest").select("digest", "owner", "keep_id", "n", F.lit(batch).alias("batch"))
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")
        try:
            dealt.write.mode("overwrite").insertInto(self.name)
        finally:
            self.spark.conf.set(mode, before)

    def compact(self) -> DigestIndex:
        """A new index with one row per digest and one file per bucket. Earlier batches cannot be repeated against it."""
        out = DigestIndex(self.spark, buckets=self.buckets)
        one = self.batches().groupBy("digest").agg(F.lit(True).alias("owner"), F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        out.write(one, "compacted")
        return out


def _digests(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(normalized(F.col("text")), 256)).alias("digest"), F.char_length(text).alias("cp"), F.xxhash64(text).alias("h"))


def _groups(slim: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """One row per digest of the batch: digest, n, new, keep_id and h of the row that stays, group_size over all batches.
    Writes the batch to the index."""
    order = F.struct(-F.col("cp"), F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("h"))
    groups = slim.groupBy("digest").agg(F.min(order).alias("b"), F.count(F.lit(1)).alias("n"))
    others = index.batches().filter(F.col("batch") != batch)
    known = others.groupBy("digest").agg(F.max("owner").alias("owned"), F.max("keep_id").alias("k"), F.sum("n").alias("before")).hint("merge")
    new = F.coalesce(~F.col("owned"), F.lit(True))
    joined = groups.join(known, "digest", "left")
    out = joined.select("digest", "n", new.alias("new"), F.when(new, F.col("b.id")).otherwise(F.col("k")).alias("keep_id"), F.col("b.h").alias("keep_h"), (F.col("n") + F.coalesce("before", F.lit(0))).alias("group_size"))
    out = materialize(out, "digest-groups")
    fresh = out.select("digest", "n", "keep_id").join(others.filter("owner").select("digest").hint("merge"), "digest", "left_anti")
    seen = out.filter("not new").select("digest", "n")
    rows = fresh.withColumn("owner", F.lit(True)).unionByName(seen.withColumns({"owner": F.lit(False), "keep_id": F.lit(None).cast("long")}))
    index.write(rows, batch)
    return out


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256. Texts are equal if they are so without
    blanks. Of a group that the index does not know, the row with most code points in the original text, then the
    smallest doc_id, stays (a null id comes last); of a group that it knows, none does, and keep_id is the one kept
    then. Fully repeated rows of the kept document are all marked. group_size counts the rows of all batches. An empty
    table gives no rows. A ``batch`` that the index has is replaced, so it may be run again; by default every call is a
    batch of its own."""
    slim = materialize(_digests(docs), "digests")  # read twice below; the texts only once
    groups = _groups(slim, index, batch or uuid.uuid4().hex)
    rows = join_groups(slim, groups, "digest", "n", slim.count())
    mine = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("h") == F.col("keep_h"))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("new") & mine).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Of each group of equal texts that the index did not know, the one row that ``deduplicate`` keeps, all its columns
    unchanged; of rows that repeat its id and text, any one. Rows are found by id and text together, so an id that has
    several texts loses none of them. Texts are shuffled once: the join also brings repeated rows together."""
    slim = materialize(_digests(docs), "digests")
    groups = _groups(slim, index, batch or uuid.uuid4().hex)
    i, h = (unused(docs, n) for n in ("__i", "__h"))
    row_key = lambda id_, text: [F.coalesce(id_, F.lit(0)).alias(i), F.xxhash64(text, id_.isNull()).alias(h)]
    kept = groups.filter("new").select(*row_key(F.col("keep_id"), F.col("keep_h")))
    rows = docs.select("*", *row_key(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))))
    return rows.join(kept, [i, h], "left_semi").dropDuplicates([i, h]).select(*docs.columns)
