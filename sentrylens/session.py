"""Session settings and lineage cuts shared by every job of the library."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; a cluster supplies its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sentrylens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def pin_settings(spark: SparkSession) -> None:
    """Settings the results depend on: times are UTC; adaptive execution handles skew."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: the cluster's setting if there is one.

    Only a session within one machine may go without: on a cluster a temporary folder would
    be another one on every machine, and tables read back from it would lack rows.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", ""
    )
    active = spark.sparkContext.getCheckpointDir()
    if active:
        return active
    master = spark.sparkContext.master
    if not configured and not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
    target = configured or tempfile.mkdtemp(prefix="sentrylens-ckpt-")
    spark.sparkContext.setCheckpointDir(target)
    return target


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back.

    Used where an intermediate result feeds several later stages: it is computed
    once and survives the loss of executors.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_dir(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, visible to every executor; gone when the session ends."""
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    files, at = files_of(spark, path)
    files.deleteOnExit(at)
    _TABLES.append(path)
    return path


def release_tables(spark: SparkSession) -> None:
    """Delete the tables staged so far. For use between jobs, when their results are written."""
    while _TABLES:
        files, at = files_of(spark, _TABLES.pop())
        files.delete(at, True)


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a columnar table and read it back.

    For an input that many branches of a plan read: upstream work is done once and every
    branch reads only its columns.
    """
    path = table_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Write ``df`` once as a table dealt by ``key`` and read it back.

    For wide rows that several joins on ``key`` read: the joins move only their other side.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"bucketed_{uuid.uuid4().hex}"
    dealt = df.repartition(n, key).write.bucketBy(n, key).format("parquet")
    dealt.options(path=table_dir(spark), compression="zstd").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # from the catalog; the files stay as long as those of other staged tables
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for df in tables:
        for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            files, at = files_of(df.sparkSession, path)
            files.delete(at, True)


_TABLES: list[str] = []


def files_of(spark: SparkSession, path: str):
    """The file system of a path, and the path in it, as the JVM has them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at
