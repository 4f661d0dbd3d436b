"""Session helpers: a tuned local session, and shipping this package to the executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the one it gives you."""
    root = str(Path(__file__).resolve().parent.parent)
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys(p for p in [root, *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p))
    b = SparkSession.builder.master(f"local[{cpus}]").appName("quern")
    settings = {
        "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's modules to the executors once, for workers that have no copy installed."""
    sc = spark.sparkContext
    if getattr(sc, "_quern_shipped", False):
        return spark
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quern-zip-")) / "quern.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(target))
    sc._quern_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as `spark.checkpoint.dir` names it.

    Where it is not set, only a local master (tests, a notebook) gets one made; on a cluster a machine-local
    folder would lose rows, so that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quern-")
        sc.setCheckpointDir(named)
        forget_at_exit(spark, named)
    return named.rstrip("/")


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a path when the driver's JVM ends, if nobody did before."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors. It goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget_at_exit(spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._quern_path = path
    return back


def forget(df: DataFrame) -> None:
    """Delete a table that written() made, once nothing lazy reads it any more."""
    delete(df.sparkSession, df._quern_path)
