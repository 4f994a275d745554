"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session of ours relies on. AQE re-plans joins from runtime
# sizes (broadcast only when the measured side is small), coalesces tiny
# shuffle partitions and splits skewed join partitions.
_BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # staged lineage cuts are deleted once no DataFrame references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(
    app: str = "choicelens",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict | None = None,
) -> SparkSession:
    """Return a session with our defaults.

    On a cluster ``master`` stays ``None`` (spark-submit decides) and names the
    shared folder in ``spark.checkpoint.dir``; tests pass ``local[N]`` and a
    folder of their own.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in _BASE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``choicelens`` importable in executor Python workers (once per app).

    Pandas UDFs and ``mapInPandas``/``applyInPandas`` functions reference this
    package; workers import it by name. The package is zipped next to the
    driver and distributed with ``addPyFile`` (the ``--py-files`` mechanism).
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="choicelens-pyfiles-"), "choicelens.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts, as the cluster names it in ``spark.checkpoint.dir``.

    Without one there is nowhere that all executors see, so this fails.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(d)
        return d
    d = spark.sparkContext.getCheckpointDir()
    if not d:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return d


def stage(df, spark: SparkSession | None = None, name: str | None = None):
    """Cut lineage with a reliable checkpoint in the shared checkpoint dir.

    Reliable checkpoints survive executor loss (unlike local checkpoints);
    use between long chains of passes so a retry does not recompute them.
    """
    spark = spark or df.sparkSession
    checkpoint_dir(spark)
    return df.checkpoint(eager=True)


# files of a shuffle go when the execution that needed them has ended (from Spark 4.1)
_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_columns(df, name: str):
    """``df`` written as compressed Parquet in the shared checkpoint folder and read again.

    For results of joins that several passes read: columns are stored packed, a
    checkpoint stores whole rows as they are in memory. The shuffles of the write go
    with its end; the files stay until ``release`` or the end of the application.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP_CONF, None)
    spark.conf.set(_CLEANUP_CONF, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP_CONF)
        else:
            spark.conf.set(_CLEANUP_CONF, before)
    fs, at = _hadoop_path(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_paths = [path]
    return out


def _hadoop_path(spark, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def release(*dfs) -> None:
    """Delete what ``stage_columns`` wrote for these frames (``staged_paths``); nothing may read them any more."""
    for df in dfs:
        for path in getattr(df, "staged_paths", ()):
            fs, at = _hadoop_path(df.sparkSession, path)
            fs.delete(at, True)


def env_sf_dir(default: str = "/root/testdata/sf0.1") -> str:
    return os.environ.get("BENCH_SF_DIR", default)
