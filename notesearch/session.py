"""A session with the settings this engine expects."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables in the shared folder and the sessions that wrote them.
_written: dict[str, SparkSession] = {}


def session(name: str = "notesearch", **settings: str) -> SparkSession:
    """An existing session, or one with adaptive execution; settings use underscores for dots."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local session without it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="notesearch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def stable(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared folder as Parquet and read back.

    It cuts lineage, survives lost executors and keeps column pruning, pushed filters and sizes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes tables of stable() that no later plan reads."""
    for table in tables:
        fs, path = _file_system(table.sparkSession, table._shared_path)
        fs.delete(path, True)
        _written.pop(table._shared_path, None)


@atexit.register
def _release_all() -> None:
    """What plans may still read stays until the driver ends."""
    for path, spark in _written.items():
        try:
            fs, jpath = _file_system(spark, path)
            fs.delete(jpath, True)
        except Exception:  # the session is gone; its owner clears the shared folder
            return


def importable(df: DataFrame) -> DataFrame:
    """df, after letting Python workers import this package from where the driver does.

    Workers on other machines need the package installed or sent with --py-files.
    """
    here, known = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), df.sparkSession.sparkContext.environment
    if here not in known.get("PYTHONPATH", "").split(":"):
        known["PYTHONPATH"] = ":".join(x for x in (known.get("PYTHONPATH"), here) if x)
    return df
