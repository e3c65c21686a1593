"""Session defaults for the engine."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, unless they find it where the driver does."""
    sc, root = spark.sparkContext, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if getattr(sc, "_chronolith_shipped", False) or root in paths or (sc.master.startswith("local[") and os.getcwd() == root):
        return
    at = os.path.join(tempfile.mkdtemp(prefix="chronolith-"), "chronolith-package.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "chronolith")):
            for name in names:
                if name.endswith(".py"):
                    z.write(path := os.path.join(folder, name), os.path.relpath(path, root))
    sc.addPyFile(at)  # served by the driver
    sc._chronolith_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share; in local mode, where none is set, one of this machine's."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        given = tempfile.mkdtemp(prefix="chronolith-")
        spark.sparkContext.setCheckpointDir(given)
    return given


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, computed once, with no plan behind them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def forget(df: DataFrame) -> None:
    """Deletes the files of a frame that checkpointed() returned and that nothing reads any more; else they would stay until
    the JVM happens to collect what refers to them."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def build_session(app: str = "chronolith", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A UTC, ANSI, adaptive session; on a cluster the master and the sizes come from spark-submit."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # checkpoints go when nothing refers to them
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
