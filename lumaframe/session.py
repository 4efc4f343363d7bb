"""Session factory and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "lumaframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults the operators assume (UTC, AQE, skew join)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else one of our own.

    Only where the setting is absent and all runs on one machine (local masters, as
    in tests) a temporary folder is made; elsewhere it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="lumaframe-")
    _made.append(made)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


_written: dict[str, SparkSession] = {}
_made: list[str] = []


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system, so that any scheme works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _written.pop(path, None)


def _clean() -> None:
    for path, spark in list(_written.items()):
        try:
            delete_path(spark, path)
        except Exception:  # the JVM may be gone already
            _written.pop(path, None)
    for folder in _made:
        shutil.rmtree(folder, ignore_errors=True)


atexit.register(_clean)


_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: later stages re-read files that every executor can
    reach, so a lost executor costs its running tasks only.  The files go when
    the Python process ends, or earlier through :func:`release`.

    ``drop_shuffles``: the write's own shuffle files are deleted as soon as it is
    done, else they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumaframe-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = spark.conf.get(_SHUFFLE_CLEANUP, "false")
    spark.conf.set(_SHUFFLE_CLEANUP, "true" if drop_shuffles else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, before)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._lumaframe_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for ``df``, once nothing reads it."""
    path = getattr(df, "_lumaframe_path", None)
    if path:
        delete_path(df.sparkSession, path)
