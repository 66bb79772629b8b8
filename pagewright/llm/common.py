"""What the operators of this subpackage share: tables in the shared folder, batches, columns."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder

#: White space that separates words, for translate() and for Java's and RE2's classes.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
#: Rows of one Arrow batch. Texts may have megabytes, so the default of 10,000 is too many.
BATCH_ROWS = 512
#: Largest table, in rows, that may be broadcast by hint; its rows are short and of fixed width.
BROADCAST_ROWS = 100_000


#: Paths of tables that the innermost scratch() removes, if there is one.
_scratch: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and a lost executor loses nothing of it. The table goes with
    the scratch() it is written in, or else when the process ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    else:
        atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at its end, so what is to last must be written outside by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _remove(spark, path)


def kept(make: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """What make() gives, as a table in the shared folder; the tables that make() writes on the way are removed."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with scratch(spark):
        df = make()
        df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Removes the files of a table of kept() that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, folder)


def shuffles_dropped(spark: SparkSession) -> None:
    """Has shuffle files go that no table needs any more. They stay until the driver collects its garbage, which it may put
    off until they fill the disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None and not sc._jsc.sc().isStopped():
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession) -> None:
    """Keeps the Arrow batches of texts small; a smaller setting of the session stays. Spark reads the setting when a plan
    runs, after the operator has returned, so it can't be put back here."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows; else Spark joins by shuffling."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def least_marks(marks: DataFrame, n: int) -> list[int]:
    """The n least distinct values of marks (mark long: a hash of what a row is), for samples of bounded size.

    Only marks below twice the share that is needed are sorted, so tasks send the driver what it needs and no more.
    """
    total = marks.count()
    few = marks if total <= 4 * n else marks.where(F.col("mark") <= -(2**63) + 2**64 * 2 * n // total)
    return [r.mark for r in few.distinct().orderBy("mark").limit(n).collect()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_in(text: Column) -> Column:
    """Number of words: maximal runs of other characters than white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
