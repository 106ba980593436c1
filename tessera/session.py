"""Session helpers.

Library code never builds its own session: every operator takes DataFrames.
These helpers exist for tests, ``bench.py`` and command-line use, and to find
the shared folder for materialised intermediates.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings the operators are written for. AQE re-plans joins from runtime sizes
# (a join side only becomes a broadcast after Spark measured it), splits skewed
# shuffle partitions and coalesces tiny ones.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "tessera", extra: dict | None = None) -> SparkSession:
    """A local session for tests and benchmarks (never used by operators)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    Executors on other machines cannot see a folder of the driver's machine, so a
    session on a cluster without the setting is refused. In local mode, where
    all tasks run in the driver's process, an unset folder becomes a scratch one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)  # a bare path is one of the default file system
        return sc.getCheckpointDir() or current
    if not is_single_process(sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share; "
                         "intermediates are written there")
    import tempfile
    scratch = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(scratch)
    return scratch


def is_single_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for a written intermediate."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tessera/{name}"


def materialize(df, name: str | None = None, partition_by: str | None = None):
    """Cut lineage: write ``df`` as Parquet under the shared checkpoint folder
    and read it back.

    One job computes the rows once; later branches read the same files (so
    two branches of a plan see identical rows, even after an executor is
    lost), and the read carries file sizes, so the optimizer can size joins.
    """
    import uuid
    spark = df.sparkSession
    path = shared_path(spark, f"{name or 'm'}-{uuid.uuid4().hex}")
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return spark.read.parquet(path)
