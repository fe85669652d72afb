"""Session helpers shared by the operators: cutting lineage, scratch folders and shipping the package."""

from __future__ import annotations

import atexit
import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Clusters name it in ``spark.checkpoint.dir``; without that a cluster is refused, as a local
    folder of one machine would lose rows. Only where one machine holds driver and executors
    (tests, a laptop) is a folder chosen.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="vellumine-"))
        held = sc._jsc.sc().getCheckpointDir()
    return named or held.get()


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, in whatever store Spark reads it from."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def scratch(spark: SparkSession, kind: str) -> str:
    """The path of a new folder in the shared one, removed when the driver's Python ends: results that read it are lazy until then."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"

    def tidy() -> None:
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone: the folder then stays, as after a crash
            return

    atexit.register(tidy)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sweep(spark: SparkSession) -> None:
    """Let go of what finished steps hold: a broadcast stays in every executor's memory, and a shuffle on its disk,
    until the driver's JVM collects the plan that made it. A broadcast table takes a whole page of memory, however small."""
    spark._jvm.System.gc()


#: Bytes of an Arrow batch between the JVM and Python: long texts make batches of few rows.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, and make this package importable on the executors unless the path they inherit has it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    paths = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if any(p and Path(p).resolve() == ROOT for p in paths):
        return
    if str(ROOT) not in sys.path:
        sys.path.insert(0, str(ROOT))
    held = getattr(spark.sparkContext, "_vellumine_zip", None)
    if held is None:
        where = Path(tempfile.mkdtemp(prefix="vellumine-")) / "vellumine.zip"
        with zipfile.ZipFile(where, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted((ROOT / "vellumine").rglob("*.py")):
                z.write(p, p.relative_to(ROOT))
            if (ROOT / "corpus_pipeline.py").exists():
                z.write(ROOT / "corpus_pipeline.py", "corpus_pipeline.py")
        spark.sparkContext.addPyFile(str(where))
        spark.sparkContext._vellumine_zip = str(where)
