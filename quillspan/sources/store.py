"""Tables between the steps of a longer computation, written to the folder that all machines share.

A step that reads such a table depends on its files alone: a lost executor costs no earlier step, and plans stay small.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it is unset, a temporary folder serves on a local master; on a cluster no
    folder of one machine would do, so that this raises."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        app = spark.sparkContext.applicationId
        folder = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="quillspan-"))
    return folder.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df and reads it again. The files go when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes the files of stored() tables at once. Nothing that is still to run may read them."""
    for table in tables:
        remove(table.sparkSession, _paths.pop(table))


def apart(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the input: both sides are shuffled and sorted. Spark takes columns made from a
    small file for small, and would gather them in the driver and send them to every executor."""
    return df.hint("merge")


def placed(df: DataFrame, name: str, by: list[str], together: bool = False) -> DataFrame:
    """stored() as a table in as many buckets as a shuffle has partitions: grouping, windows and joins by the columns `by`
    (grouping and windows also by more columns) read it without an exchange.

    together: df ends in a shuffle by these columns already, so that writing needs none either. All rows of a key lie in
    one bucket, which Spark doesn't split when it reads: keys are to be bounded, such as a document's label. Null keys
    share a bucket. The table leaves the catalogue with its files."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"quillspan_{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    rows = df if together else df.repartition(buckets, *by)
    rows.write.option("compression", "zstd").option("path", path).bucketBy(buckets, *by).saveAsTable(table)
    atexit.register(_dropped, spark, table, path)
    return spark.table(table)


def _dropped(spark: SparkSession, table: str, path: str) -> None:
    with contextlib.suppress(Exception):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    remove(spark, path)


def dealt(df: DataFrame) -> DataFrame:
    """A plain scan, its rows dealt out where it would be fewer tasks than there are cores: then it is small, since large
    files are split, or it is a few files that cannot be split. A scan of more tasks is read as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
