"""What several of the training-data operators need."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``; a null key is in fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % of, F.lit(0))


def labelled_sample(labels: DataFrame, key: str, label: str, learn: Column, bound: int) -> DataFrame:
    """At most ``bound`` labelled keys, chosen by hash: (key, y). ``learn`` says which rows may be learned from."""
    return (
        labels.filter(learn & F.col(label).isin(0, 1) & F.col(key).isNotNull())
        .select(key, F.col(label).cast("int").alias("y"))
        .orderBy(F.xxhash64(key), key, "y")
        .limit(bound)
    )


#: Folders that ``shared_folder`` has named since the last ``cleared``.
_made: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset a local session, as in tests, has one below its warehouse; a cluster is refused, as its machines need not share that."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = root or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    _made.append(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> int:
    """How many intermediate folders there are, to be given to ``cleared``."""
    return len(_made)


def cleared(spark: SparkSession, since: int = 0, but_last: bool = False) -> None:
    """Remove the intermediate tables made since, all or all but the last; call it when the results that read them are written."""
    gone = _made[since : len(_made) - but_last]
    for folder in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _made[since : since + len(gone)] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there, and any executor can read it again."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
