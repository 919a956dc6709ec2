"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings the operators assume. Time zone is pinned so day boundaries and
# epoch conversions do not depend on where the driver runs.
_REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str | None = None, app: str = "brandlens",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or fetch) a session with the engine's settings.

    On a cluster pass ``master=None`` and let spark-submit decide. Locally,
    ``shuffle_partitions`` should be about the core count.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    b = b.config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for k, v in _REQUIRED.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session (idempotent)."""
    for k, v in _REQUIRED.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory, setting one only when none is configured.

    On a cluster ``spark.checkpoint.dir`` names a shared, fault-tolerant folder and is
    used as is. Only when it is unset and the master is local is a scratch folder created;
    a cluster without it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif not sc.master.startswith("local"):
        # every executor would write to its own disk and the stage would be lost
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    else:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="brandlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp")))
    return sc.getCheckpointDir()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory for materialised tables."""
    base = ensure_checkpoint_dir(spark)
    import uuid

    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at `path`, or None if nothing is there yet. Any other failure (storage,
    permission, damaged files) is raised: an unreadable table is not an empty one."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def materialise(df, name: str = "stage"):
    """Cut lineage by writing `df` as Parquet under the shared checkpoint folder and
    reading it back. Unlike an RDD checkpoint the plan runs once, the files are
    columnar (later reads prune columns), and a lost executor never forces a
    recomputation of what was written. What the write shuffled is deleted when it ends, as
    nothing reads it again; `release` deletes the table itself."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.parquet(path)
    out._stage_path = path
    return out


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def release(*tables) -> None:
    """Delete tables that `materialise` returned (others are left alone) once nothing reads them."""
    for table in tables:
        path = getattr(table, "_stage_path", None)
        if path:
            jvm = table.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
