"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every operator here counts it: a run of anything but space, \t, \n, \v, \f and \r.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names; choose one only where none is named."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if sc.master.startswith("local[") or sc.master == "local":
            named = tempfile.mkdtemp(prefix="lanternfish-")
        else:
            named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    sc.setCheckpointDir(named)


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: that of the checkpoints."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that is no longer read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Rows of a partition below which a checkpoint is read in fewer tasks.
SMALL_PARTITION = 20_000


def settled_rows(df: DataFrame, rows: int = SMALL_PARTITION, most: int | None = None) -> tuple[DataFrame, int]:
    """As settled, and how many rows there are. most: a bound on them where one is known, so that few files are written."""
    if most is not None:
        df = df.coalesce(max(1, -(-most // rows)))
    done = checkpointed(df)
    n = done.count()
    return done.coalesce(max(1, min(done.rdd.getNumPartitions(), -(-n // rows)))), n


def settled(df: DataFrame, rows: int = SMALL_PARTITION, most: int | None = None) -> DataFrame:
    """A checkpoint that is read by no more tasks than its rows need: for the small tables of iterative algorithms.

    Every task of a later shuffle leaves files of its own, so many tasks with few rows cost disk and time.
    """
    return settled_rows(df, rows, most)[0]


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle files and checkpoints that no table refers to any more.

    Its cleaner acts when the driver's JVM collects garbage, which between rounds may not happen for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def marks(text: Column, kinds: str) -> Column:
    """The characters of a text that a class of a pattern has, in order: counted in place of the text, which is far longer."""
    return F.regexp_replace(text, f"[^{kinds}]+", "")


def let(value: Column, body) -> Column:
    """Evaluate an array once, and use it several times in body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def number_from_md5(text: Column, digits: int = 15) -> Column:
    """A non-negative long from the leading hex digits of an md5, as other engines compute it too."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")
