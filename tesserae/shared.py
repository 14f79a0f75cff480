"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tesserae.errors import TesseraeError

#: Makes Spark delete a query's shuffle files when the query ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a temporary one if all runs in this process, else an error."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("tesserae.shared.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise TesseraeError("spark.checkpoint.dir is unset: a cluster needs a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        spark.conf.set("tesserae.shared.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage ends here and a lost executor costs nothing. The shuffle files of making it are deleted at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _paths(df: DataFrame) -> set[str]:
    """The folders of tables made by written() that df reads."""
    own = shared_dir(df.sparkSession)
    marks = ("file:" + own.split(":", 1)[-1].replace("//", "", 1), own)
    return {p for p in (f.rsplit("/", 1)[0] for f in df.inputFiles()) if p.startswith(marks)}


def discard(*frames: DataFrame) -> None:
    """Deletes tables made by written() that no plan will read again."""
    for df in frames:
        spark = df.sparkSession
        for path in _paths(df):
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored_bytes(df: DataFrame) -> int:
    """Bytes on disk of a table made by written()."""
    spark, total = df.sparkSession, 0
    for path in _paths(df):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        total += p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return total
