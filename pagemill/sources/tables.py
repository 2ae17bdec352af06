"""Readers and sinks; every table is a parquet file or folder below one directory."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data directory, pruned to the given columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Spread a scan with fewer partitions than cores; a small single-file table would otherwise be one task.

    Inputs that already have two partitions a core stay as they are, so nothing is shuffled at scale.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def per_delivery(df: DataFrame, key: str, source: str, result: Column, name: str = "result") -> DataFrame:
    """(key, name): the result of a row function for every different delivery, that is every different (key, source), once.

    The function runs where the row was read; what is shuffled is the key, a 128-bit hash of the source and the result, never the source.
    Equal deliveries have equal results, so they collapse before the shuffle too. Maps can't be compared: give their entries.
    """
    done = spread(df).select(key, F.unhex(F.md5(F.col(source).cast("binary"))).alias("_h"), result.alias(name))
    return done.groupBy(key, "_h").agg(F.get(F.collect_set(name), F.lit(0)).alias(name)).drop("_h")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset (local runs)."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if known:
        return known
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="pagemill-")
    sc.setCheckpointDir(own)
    return own


_CUT: list[str] = []


def _delete(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))


def release(spark: SparkSession) -> int:
    """Delete the tables that cut has written in this process, once the results that read them are saved; how many there were."""
    done = 0
    while _CUT:
        done += _delete(spark, _CUT.pop())
    return done


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut has written and that nothing reads any more, such as those of an earlier round."""
    for df in tables:
        path = getattr(df, "_cut", None)
        if path in _CUT:
            _CUT.remove(path)
            _delete(df.sparkSession, path)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and keeps the work if executors are lost."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _CUT.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Pages from parquet, json, csv, text (one page a line) or whole html files (fmt 'files': path, html)."""
    if fmt == "files":
        return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))
    return spark.read.format(fmt).load(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as (path, data)."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("data"))


def read_decoded_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files of all kinds that the JVM can decode (JPEG and GIF too) as (path, width, height, channels, pixels in BGR order)."""
    return spark.read.format("image").load(path).select(F.col("image.origin").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels"))
