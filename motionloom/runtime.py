"""Session settings, table loading and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "motionloom", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the engine expects; values given as keywords win."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**settings, **{k.replace("__", "."): str(v) for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="motionloom-")) / "motionloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; a file and a folder of part files read alike."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share.

    The session's ``spark.checkpoint.dir`` is used where it is set. Only a local
    master may fall back to a temporary folder, as all its tasks run on this machine.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = "file://" + os.path.join(tempfile.gettempdir(), f"motionloom-checkpoints-{os.getpid()}")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files.

    The files outlive any executor, so a lost executor never costs the work before the cut.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns under engine-internal names, so extra or clashing columns can't interfere."""
    return df.select(*[F.col(f"`{src}`").alias(name) for name, src in wanted.items()])


def spread(df: DataFrame, most_per_core: int = 32 << 20) -> DataFrame:
    """``df`` over as many partitions as there are cores, where it comes from fewer files than that.

    For work in Python, which would else run on one core when a small table lies in one file.
    A table that has enough files, or is large and so is split by the scan itself, stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > most_per_core * cores or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


def finite(c: Column) -> Column:
    """Null for NaN and the infinities, else the value."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)
