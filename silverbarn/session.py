"""Session settings and the few helpers every operator shares."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: What the engine relies on; everything else is left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(app: str = "silverbarn", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; ``conf`` keys use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers, once per context.

    The archive is written to the shared folder that ``spark.checkpoint.dir``
    names; without one, as in tests, the driver hands out a file of its own.
    """
    sc = spark.sparkContext
    if getattr(sc, "_silverbarn_shipped", False):
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    shared = sc.getConf().get("spark.checkpoint.dir")
    if shared:
        folder = sc._jvm.org.apache.hadoop.fs.Path(f"{shared.rstrip('/')}/silverbarn-{sc.applicationId}")
        fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())
        target = sc._jvm.org.apache.hadoop.fs.Path(folder, "silverbarn.zip")
        out = fs.create(target, True)
        out.write(packed.getvalue())
        out.close()
        fs.deleteOnExit(folder)
        sc.addPyFile(fs.makeQualified(target).toString())
    else:
        archive = Path(tempfile.mkdtemp(prefix="silverbarn-")) / "silverbarn.zip"
        archive.write_bytes(packed.getvalue())
        sc.addPyFile(str(archive))
    sc._silverbarn_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _shared_folder(spark: SparkSession) -> str:
    """The context's checkpoint folder.

    It lies where the cluster names it in ``spark.checkpoint.dir``. Only where
    that is unset and the master is local (tests) a folder of our own is used,
    since a machine-local folder would not survive a lost executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="silverbarn-checkpoint-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``cut_lineage`` as a Parquet table: smaller, for many rows that are read once or twice; it goes when the driver ends."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{_shared_folder(spark)}/table-{uuid4().hex}")
    df.write.parquet(path.toString())
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(path.toString())
