"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers once, wherever it is installed on the driver."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        top = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="factloom-")) / f"{top.name}-lib.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        context.addPyFile(str(target))
        _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, as in tests, a temporary folder on a local master; on a cluster that
    is an error, as executors wouldn't see each other's files."""
    if (folder := spark.conf.get("spark.checkpoint.dir", None)) is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _OWN.setdefault("dir", tempfile.mkdtemp(prefix="factloom-"))
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read again, so that several uses don't compute it several times."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
