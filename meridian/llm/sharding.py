"""Rendezvous hashing over weighted shards, as DataFrame expressions only.

Every key scores every shard, -weight / ln(u) with u a hash of (key, shard) in (0, 1), and goes to the best. A new
shard changes no other score, so it only takes records; none moves between old shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shard_score(key: Column, shard: int, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    return F.lit(-float(weight)) / F.log(u)


def assign(docs: DataFrame, key: str, weights: Sequence[float], names: tuple[str, str] = ("shard", "grown_shard"), grown_weight: float | None = None) -> DataFrame:
    """``docs`` with the shard of each row, an index into ``weights`` (all above 0), and the shard it would have if
    one shard of ``grown_weight`` (default: the mean weight) were added. Rows with equal keys share a shard, null
    keys too."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be above 0, and one at least")
    k, n = F.col(key), len(weights)
    scores = [F.struct(shard_score(k, i, w).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(weights)]
    best = F.array_max(F.array(*scores))
    extra = shard_score(k, n, grown_weight or sum(weights) / n)
    out = docs.withColumn("__best", best).withColumn("__extra", extra)
    shard = -F.col("__best.i")
    return out.withColumns({names[0]: shard, names[1]: F.when(F.col("__extra") > F.col("__best.s"), F.lit(n)).otherwise(shard)}).drop("__best", "__extra")


def with_slots(docs: DataFrame, shard: str, key: str, rows: int, slot: str = "slot", rows_per_task: int = 200_000, also: Sequence[str] = ()) -> DataFrame:
    """Number the rows of each shard from 0 without a gap. A shard is cut into pieces by a hash of the key and of the
    columns ``also``, so that a task numbers about ``rows_per_task`` rows, of ``rows`` in all, even where many rows have
    one key or none; a small table of counts says where each piece begins."""
    pieces = max(1, -(-rows // rows_per_task))
    piece = F.pmod(F.xxhash64(F.col(key), F.lit("slot"), *also), F.lit(pieces)).cast("int")
    cut = docs.withColumn("__piece", piece)
    before = Window.partitionBy(shard).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(shard, "__piece").agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.select(F.col(shard).alias("__s"), F.col("__piece").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    rank = F.row_number().over(Window.partitionBy(shard, "__piece").orderBy(key, *also))
    numbered = cut.withColumn("__r", rank)
    joined = numbered.join(counts, (F.col(shard) == F.col("__s")) & (F.col("__piece") == F.col("__p")))
    return joined.withColumn(slot, F.col("__from") + F.col("__r") - 1).drop("__piece", "__s", "__p", "__from", "__r")


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * 40) -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, law, shard, slot, grown_shard. A null text
    has no bytes and crc32 0; repeated rows share a shard and have slots of their own; an empty table gives no row."""
    rows = docs.select("doc_id").count()
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    placed = with_slots(assign(slim, "doc_id", weights), "shard", "doc_id", rows, also=("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", "law", F.col("shard").cast("int"), F.col("slot").cast("long"), F.col("grown_shard").cast("int"))
