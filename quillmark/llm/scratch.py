"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="quillmark-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return f"file://{_OWN['dir']}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back; lost executors lose nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmark-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._quillmark_path = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no later step reads."""
    for t in tables:
        jvm, path = t.sparkSession._jvm, t._quillmark_path
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
