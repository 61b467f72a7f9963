"""Sessions and durable intermediate results."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and single-machine runs; clusters bring their own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("oddsloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate results: the one the cluster names in ``spark.checkpoint.dir``, or the context's own.

    A local session without either gets a temporary folder, which becomes the
    context's. On a cluster that would be a disk of the driver alone, so there
    it is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: intermediate results need a folder that driver and executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="oddsloom-checkpoint-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in :func:`shared_folder`; runs at once."""
    folder = shared_folder(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in :func:`shared_folder` and read again; runs at once.

    As :func:`durable`, for tables that hold rows of the input: columns are
    packed, and a later job reads those alone that it needs. A table of its
    own folder goes when the process ends.
    """
    return Scratch(df.sparkSession, "stored").written(df, "table")


class Scratch:
    """Tables of one job in a folder of its own under :func:`shared_folder`.

    Tables that a later one replaces are dropped by the job. Results are read
    lazily, so what is left goes when the process ends, or by :meth:`close`.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        atexit.register(self._quiet_close)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet and read again: its lineage ends here."""
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Remove one table, or all of them; none is no error."""
        path = self._path(self.path(name) if name else self.folder)
        path.getFileSystem(self._conf).delete(path, True)

    def close(self) -> None:
        atexit.unregister(self._quiet_close)
        self.drop()

    def _quiet_close(self) -> None:
        try:
            self.drop()
        except Exception:  # noqa: BLE001  the JVM may have gone before
            pass


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, unless they find it where the driver does.

    Python workers see PYTHONPATH and the folder that the driver was started in.
    """
    root = Path(__file__).resolve().parents[1]
    seen = [Path(p).resolve() for p in (*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()) if p]
    context = spark.sparkContext
    if root in seen or context.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="oddsloom-ship-")) / "oddsloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted((root / "oddsloom").rglob("*.py")):
            z.write(path, path.relative_to(root))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
