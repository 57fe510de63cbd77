"""Working tables: results that a plan reads several times, written once to the shared folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``; a local one only where Spark runs in one process and has none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sievestone-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


#: While a tidy table is written, shuffle files go with the job that wrote them.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tidy: bool = False) -> DataFrame:
    """``df`` as a table: what reads it again, or loses an executor, doesn't start over. ``tidy``: its shuffle files go when it is written."""
    path, conf = shared_folder(df.sparkSession), df.sparkSession.conf
    before = conf.get(TIDY, None)
    try:
        if tidy:
            conf.set(TIDY, "true")
        df.write.parquet(path)
    finally:
        conf.set(TIDY, before) if before is not None else conf.unset(TIDY)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made and that nothing reads any more."""
    for table in tables:
        jvm, hadoop = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)
