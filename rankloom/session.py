"""Session settings the operators are written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Feature rows are wide, and the JVM does not compile methods above 8,000
# bytes. Past that size Spark should split the work instead of fusing it.
# Pages and texts have any length, so what Python gets at once is bounded by
# bytes (16 MB, or one row) and not by rows alone.
TUNING = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.execution.arrow.maxBytesPerBatch": "16777216"}


def tune(spark: SparkSession) -> SparkSession:
    """Session settings the wide feature projections need to run compiled; safe to repeat."""
    for key, value in TUNING.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "rankloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **TUNING,
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Executors on other hosts cannot read a scratch folder of the driver, so
    only a session on one machine may go without the setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="rankloom-shared-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Written as Parquet to the shared folder and read back: for wide rows of which later steps read some columns or rows. ``options`` are the writer's."""
    folder = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read from there on: the lineage ends, and a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
