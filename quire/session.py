"""Session set-up and lineage cutting.

Python workers import ``quire``: on a cluster the package is installed on every node or shipped with
``--py-files``; in tests the repository is on ``PYTHONPATH``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Arrow batches of wide text rows stay small enough for a worker's memory.
TEXT_BATCH_ROWS = "1000"


def local_session(cores: int = 8, app: str = "quire", **conf: str) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (here, os.environ.get("PYTHONPATH")) if p)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate results that all executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets its own, which goes when the process ends.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            import atexit
            import shutil
            import tempfile

            shared = tempfile.mkdtemp(prefix="quire-checkpoint-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for a table that is written once and read several times."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably: a checkpoint in the shared folder.

    Clusters that set ``spark.cleaner.referenceTracking.cleanCheckpoints`` drop it with its last reference.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
