"""Session defaults, and the shared scratch folder jobs may write to."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def send_code_with_tasks() -> None:
    """Ship this package's functions inside the tasks.

    Needed when the package is not installed on the executors, nor passed with ``--py-files``.
    """
    cloudpickle.register_pickle_by_value(sys.modules["cashtide"])


def local_session(cores: str = "*", app: str = "cashtide", **conf: str) -> SparkSession:
    """A session for tests and the benchmark. On a cluster, pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        # Recording the call site of every expression would dominate the building of a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared one named by ``spark.checkpoint.dir``.

    Executors may be lost, so what is written must be readable from every machine. Only a
    single-machine session may fall back to a local temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        shared = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
