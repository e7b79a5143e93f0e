"""Session helpers: the shared checkpoint folder and shipping this package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder: there the driver and the
    executors are one process. A cluster without a shared folder is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="roadloom-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage, so lost executors lose nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(spark: SparkSession, rows: int | None = None) -> int:
    """Partitions for few rows that make much work, which adaptive execution would gather by their bytes.

    Up to the session's shuffle partitions, but of fewer than 1,000 ``rows`` each only as far as there are cores for them: a task
    that is shuffled on writes a file for each partition of the next stage, so small ones take longer than their work.
    """
    most, cores = int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism
    return max(most if rows is None else min(most, rows // 1000), cores)


#: Bytes of an Arrow batch: rows may be large, and a task holds several batches at a time.
ARROW_BATCH, ARROW_KEY = "8m", "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as ``--py-files`` would, and keep Arrow batches small.

    A session that sets its own size of batches keeps it.
    """
    if spark.conf.get(ARROW_KEY) in ("67108864b", "64m"):  # Spark's default
        spark.conf.set(ARROW_KEY, ARROW_BATCH)
    sc = spark.sparkContext
    if getattr(sc, "_roadloom_shipped", False):
        return
    sc._roadloom_shipped = True
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="roadloom-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "roadloom_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for at, dirs, names in os.walk(root):
            dirs[:] = sorted(d for d in dirs if d != "__pycache__")
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    out.write(full, os.path.join("roadloom", os.path.relpath(full, root)))
    sc.addPyFile(path)
