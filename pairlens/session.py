"""Session helpers: settings the jobs rely on, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job assumes. UTC so time stamps agree with the oracle; AQE so
# shuffles coalesce and skewed joins split at run time.
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows with whole texts or blocks of vectors go to Python; Spark also limits a batch by bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # The matching expressions are large (nested higher-order functions);
    # constraint inference over them costs seconds of planning and prunes nothing.
    "spark.sql.constraintPropagation.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "pairlens") -> SparkSession:
    """Build (or reuse) a session with the job settings applied.

    ``master`` is only set when given, so on a cluster the launcher decides.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the whole cluster
            b = b.config("spark.driver.memory", "16g")
    b = b.config("spark.ui.enabled", "false")
    for k, v in JOB_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    apply_job_conf(spark)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_job_conf(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to an existing session (e.g. the driver's)
    and make the package importable by the Python workers."""
    for k, v in JOB_CONF.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application (``addPyFile``),
    so ``mapInPandas`` helpers import on workers as they do on the driver."""
    import zipfile
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    pkg = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="pairlens-pkg-")) / "pairlens.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in pkg.rglob("*.py"):
            z.write(f, f.relative_to(pkg.parent))
    spark.sparkContext.addPyFile(str(out))
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder (``spark.checkpoint.dir``).

    Where it is unset, a session in one local process (tests) gets a fresh scratch
    folder; on a cluster, whose machines share no local folder, that is an error.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        spark.sparkContext.setCheckpointDir(conf_dir)
        return spark.sparkContext.getCheckpointDir()
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="pairlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir()
