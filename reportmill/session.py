"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM never compiles methods beyond 8000 bytecodes; text rules in one fused method would be interpreted.
    # Above this size Spark uses split projections instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Shuffle files go with the step that wrote them. Else they stay until the driver collects garbage, and jobs of many steps fill the disk.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def build_session(app: str = "reportmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on; ``conf`` entries win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """Pins what the library relies on in a session somebody else built: UTC wall clocks, compilable methods, no leftover shuffle files."""
    for key in ("spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"):
        spark.conf.set(key, SETTINGS[key])
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local-mode session without that
    setting (tests) gets a folder of its own; on a cluster a machine-local folder would vanish
    with its executor, so a missing setting is an error there.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="reportmill-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder
