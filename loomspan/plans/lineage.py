"""Sessions and lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "loomspan", cores: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the engine relies on; a cluster passes its own."""
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        # Checkpoints go once nothing refers to them.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _shared(spark: SparkSession) -> None:
    """Set the folder of checkpoints where it is not set yet."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "loomspan-checkpoints"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path beside the checkpoints, for tables that a query writes and reads again."""
    _shared(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and continue from a reliable checkpoint in the shared folder.

    The folder is the one named by ``spark.checkpoint.dir``. Where that is unset,
    a local session, as in tests, uses a folder under the local temporary
    directory; on a cluster, whose machines do not share that, it is an error.
    """
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame) -> DataFrame:
    """``cut``, and forget what the planner made of the plan before it.

    A checkpoint keeps its plan's estimate of bytes. Joins multiply estimates, so
    a loop that joins its state to itself doubles or triples the digits of the
    number each round, until planning takes longer than the work. Here the size
    is unknown to the planner, and joins go by the sizes of shuffles as they run.
    """
    spark, done = df.sparkSession, cut(df)
    return DataFrame(spark._jsparkSession.createDataFrame(done._jdf.toJavaRDD(), done._jdf.schema()), spark)
