"""Session construction and cluster-safe lineage cutting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "tessera", extra: dict | None = None) -> SparkSession:
    """A session with AQE, skew handling and Arrow on; the UI stays off.

    On a cluster ``master`` is left to spark-submit; tests and the bench pass
    ``local[N]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    local = master is not None and master.startswith("local")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Arrow batches bound the memory of every pandas function.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        # checkpoint files of unreachable checkpointed data are removed by Spark's cleaner
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.driver.memory": os.environ.get("TESSERA_DRIVER_MEMORY", "16g"),
    }
    if shuffle_partitions or local:
        # local runs: one shuffle partition per core; on a cluster leave the
        # setting to the job's configuration (sized to the data)
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    if not local:
        conf.pop("spark.driver.memory")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ensure_shipped(spark: SparkSession | None = None) -> None:
    """``ship_package`` for the given or the active session (no-op without one)."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None:
        ship_package(spark)


ARROW_BYTES, ARROW_DEFAULT, ARROW_OURS = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", str(8 << 20)


def bound_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds of its input: where the session has Spark's own limit of 64 MB for an
    Arrow batch, 8 MB.  Rows vary in size, so a limit by rows alone does not bound it."""
    if spark.conf.get(ARROW_BYTES) == ARROW_DEFAULT:
        spark.conf.set(ARROW_BYTES, ARROW_OURS)


def ship_package(spark: SparkSession) -> None:
    """Make ``tessera`` importable on executors (the programmatic ``--py-files``):
    the Arrow UDFs pickle functions by module reference.  The package is zipped
    on the driver once per application and distributed by ``addPyFile``."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import shutil
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="tessera-pkg-")
    archive = shutil.make_archive(os.path.join(out, "tessera"), "zip", os.path.dirname(pkg), "tessera")
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only a local-mode session (tests, bench) without one gets a fresh
    scratch folder; a cluster session without the setting is an error,
    because a machine-local folder does not survive executor loss.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if d:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(d)
        return d
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...)")
    d = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (never localCheckpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
