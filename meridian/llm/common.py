"""What the operators of this subpackage share: scratch tables and folds."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by a local session that names no shared folder, as in tests; a cluster must name one.
LOCAL_SCRATCH = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session is given
    a local one; any other is refused, since its executors would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_SCRATCH
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/meridian/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def discard(df: DataFrame) -> None:
    """Remove the files of a table of ``materialize`` that nothing will read again."""
    jvm = df.sparkSession._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner", share: float = 1e-3) -> DataFrame:
    """``rows`` joined by ``key`` with ``groups``, which has one row per key and in ``size`` the number of its rows, of
    ``total`` rows in all. Keys that hold at least ``share`` of the rows are 1 / ``share`` at most, so they are
    broadcast and their rows stay where they are; only the rows of other keys are shuffled. Rows with a null key are
    left out of an inner join and must not be given to another."""
    heavy = groups.filter(F.col(size) >= max(1.0, total * share)).drop(size)
    light = groups.filter(F.col(size) < max(1.0, total * share)).drop(size)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(rest.join(light, key, how))


def fold(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text (fold 0)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    return fold(id_col, folds) == 0


def unit_hash(*cols, seed: int = 0) -> Column:
    """A stable hash in [0, 1) of the columns, for bounded samples that any run draws alike."""
    h = F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in cols])
    return F.shiftrightunsigned(h, 11).cast("double") * F.lit(2.0**-53)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows of an Arrow batch; documents are long, so the default of 10,000 would take too much memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def mark_likely(df: DataFrame, key: str, ids: DataFrame, id_col: str, name: str, bits: int = 24) -> DataFrame:
    """``df`` with a column ``name``: false where the key is not in ``ids`` for sure. A bitmap of hashed ids, of 2**bits
    bits whatever their number, is broadcast."""
    slot = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(1 << bits))
    words = ids.select(slot(id_col).alias("__h")).groupBy(F.shiftright("__h", 6).alias("__w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(__h & 63 as int))")).alias("__m"))
    marked = df.withColumn("__h", slot(key)).join(F.broadcast(words), F.shiftright("__h", 6) == F.col("__w"), "left")
    return marked.withColumn(name, F.coalesce(F.expr("shiftright(__m, cast(__h & 63 as int)) & 1 = 1"), F.lit(False))).drop("__h", "__w", "__m")


def release_memory() -> None:
    """Give back what Arrow holds for reuse: a Python worker stays for the tasks of later stages."""
    pa.default_memory_pool().release_unused()


def likely_in(df: DataFrame, key: str, ids: DataFrame, id_col: str, bits: int = 24) -> DataFrame:
    """The rows of ``df`` whose key is in ``ids``, and a few others: it drops most rows before a join with ``ids``
    shuffles the rest."""
    return mark_likely(df, key, ids, id_col, "__likely", bits).filter("__likely").drop("__likely")


def keep_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows, all their columns unchanged, whose doc_id is in ``ids``; of fully repeated ones, one. Rows are shuffled
    by doc_id once: the join brings repeated rows together."""
    wanted = ids.select("doc_id").filter("doc_id is not null").distinct()
    return docs.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
