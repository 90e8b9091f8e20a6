"""Tables that cut an iterative plan's lineage, in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_sent: set[str] = set()


def send_modules(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application: theirs may lack its path. To be called before
    a plan with Python functions is built."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    _sent.add(context.applicationId)
    package = Path(__file__).resolve().parent.parent
    at = tempfile.mkdtemp(prefix="package-")
    atexit.register(shutil.rmtree, at, True)
    file = Path(at) / f"{package.name}-package.zip"
    with zipfile.ZipFile(file, "w") as out:
        for module in sorted(package.rglob("*.py")):
            out.write(module, module.relative_to(package.parent))
    context.addPyFile(str(file))


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where that is unset and all of Spark runs on
    this machine. On a cluster without a shared folder there is no place for a table."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if root is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = Path(tempfile.mkdtemp(prefix="forest-")).as_uri()
        context.setCheckpointDir(root)
    return root


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_all() -> None:
    for spark, path in _made:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, which goes when its scope or the driver ends."""
    spark = df.sparkSession
    path = f"{shared_root(spark).rstrip('/')}/forest/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_all)
    _made.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope() -> Iterator[None]:
    """Tables staged within go at its end: for runs that are repeated, such as micro-batches. Nothing lazy that
    reads them may be used afterwards."""
    before = len(_made)
    try:
        yield
    finally:
        own, _made[before:] = _made[before:], []
        for spark, path in own:
            _remove(spark, path)
