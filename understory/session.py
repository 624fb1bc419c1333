"""Shared-folder handling: where lineage is cut and scratch tables are written."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own, which goes
    when the process ends; on a cluster a machine-local folder would not be seen by
    the other machines.
    """
    sc = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY)
    if not folder:
        folder = sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        sc._understory_scratch = tempfile.TemporaryDirectory(prefix="run-")
        folder = sc._understory_scratch.name
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and cut its lineage."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of an Arrow batch. Texts may be long, and a worker holds its batch and what becomes of it.
BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "2m"


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the workers, once per application: they need not have it installed.

    Arrow batches are made smaller, unless the session says how large they are.
    """
    if spark.conf.get(BATCH_KEY, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    sc = spark.sparkContext
    if getattr(sc, "_understory_shipped", False):
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="package-")) / "understory.zip"  # the driver's own; Spark serves it
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(here.rglob("*.py")):
            z.write(path, path.relative_to(here.parent))
    sc.addPyFile(str(archive))
    sc._understory_shipped = True
