"""Helpers that the operators share: the shared folder, written tables, column selection."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and the master is local (tests) a temporary
    folder is made and set; a cluster without one is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        found = "file://" + tempfile.mkdtemp(prefix="webdistill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/webdistill/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a scan of it; this cuts the lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with released(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is run within are deleted once it has run, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fits(rows: DataFrame, most: int = 32 << 20) -> bool:
    """Whether rows of ids may be broadcast: their count times the widest value of each column is at most ``most`` bytes."""
    width = sum((F.coalesce(F.max(F.octet_length(c)), F.lit(0)) + 16 if kind in ("string", "binary") else F.lit(8) for c, kind in rows.dtypes), F.lit(0))
    n, wide = rows.agg(F.count("*"), width).first()
    return n * wide <= most


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table that ``save`` made, once nothing reads it any more."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as make it no column of ``df`` (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the rows whose id is in the one column of ``ids`` (null like any other).

    The ids are written first; those that fit are broadcast, so that texts aren't shuffled to lose a few of them.
    """
    gone = unused(docs, "gone")
    ids = save(ids.toDF(gone), "rejected")
    return docs.join(F.broadcast(ids) if fits(ids) else ids, F.col(id_col).eqNullSafe(F.col(gone)), "left_anti")
