"""The folder that driver and executors share, and tables written there to end a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where the session names none, a folder below the warehouse, or in local mode, where executors run in
    the driver's process, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        local = master == "local" or master.startswith("local[")
        folder = tempfile.mkdtemp(prefix="corpuslens-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/corpuslens-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: On local disks Hadoop spawns processes to set permissions, for each file, again for its checksum's and for each folder. Without files of checksums it is
#: half as many; Parquet's own checksums are verified instead. Other stores ignore this.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
VERIFIED = {"parquet.page.write-checksum.enabled": "true", "parquet.page.verify-checksum.enabled": "true"}


def cut(df: DataFrame, into: list[str] | None = None) -> DataFrame:
    """Materialise `df` as Parquet in the shared folder and read it back: lineage ends, lost executors cost nothing.

    `into` gets the path, for remove() once nothing reads it any more."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corpuslens-{uuid.uuid4().hex}"
    df.write.options(**PLAIN, **VERIFIED).parquet(path)
    if into is not None:
        into.append(path)
    return spark.read.options(**VERIFIED).schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete what cut() wrote, through the file system of each path; the list is emptied."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
