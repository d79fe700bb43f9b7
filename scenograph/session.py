"""Session settings and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}  # folders in the shared folder, by application


def build(app: str = "scenograph", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the command line; on a cluster the submitter's settings win."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master)
        if master.startswith("local["):  # driver and executor are one process
            b = b.config("spark.driver.memory", "8g")
    return (
        b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset the checkpoint folder of the context.

    Where neither is set, a session on one machine (tests) gets a new temporary folder; on a cluster that is an error, since no local folder serves there.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not d:
        set_already = sc._jsc.sc().getCheckpointDir()
        if set_already.isDefined():
            return set_already.get().rstrip("/")
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="scenograph-"))
        return sc._jsc.sc().getCheckpointDir().get().rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives the loss of executors, and runs df once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._scratch)


def clear_scratch(spark: SparkSession) -> None:
    """Delete everything this application put into the shared folder; call it when its results are written."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
