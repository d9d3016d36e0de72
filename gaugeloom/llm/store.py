"""Tables written to the folder that driver and executors share.

Written tables cut the lineage: a lost executor costs the reading tasks a retry
from shared storage, not a recomputation of everything before.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_paths: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode, and an error on a cluster, whose machines share none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.gettempdir()}/gaugeloom-{spark.sparkContext.applicationId}"
    return path.rstrip("/")


def written_at(df: DataFrame, name: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    """`df` written once as Parquet in the shared folder and read back, and where it is, for drop()."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back."""
    return written_at(df, name, compression)[0]


def drop(spark: SparkSession, path: str) -> bool:
    """Deletes one table that written_at() has made, when nothing reads it any more."""
    _paths.remove(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def made() -> int:
    """How many tables written() has made that are not deleted yet; a mark for discard()."""
    return len(_paths)


def discard(spark: SparkSession, since: int = 0, keep: str | None = None) -> int:
    """Deletes the tables that written() has made in this process since a mark of made(), but not `keep`, when no result that reads them is needed; returns their number."""
    return sum(drop(spark, path) for path in _paths[since:] if path != keep)


def some(df: DataFrame, key: str, limit: int, seed: int) -> DataFrame:
    """`key` of the `limit` rows with the smallest hashes of it, or of all if there are fewer. At most `limit` rows.

    A threshold on the hash, from the number of rows, leaves about twice as
    many to be put in order, however large df is.
    """
    place = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40))
    n = df.count()
    few = df.select(key, place.alias("_o"))
    few = few.where(F.col("_o") < F.lit(min(1 << 40, (2 * limit + 1_000) * (1 << 40) // max(n, 1))))
    return few.orderBy("_o", key).limit(limit).select(key)
