"""Session defaults and lineage control shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on.  Skewed shuffle partitions are split by
# adaptive execution even where the split costs one more exchange; nothing is
# broadcast beyond the size that Spark itself measures.  Its estimates from file sizes
# don't count: they know neither compression nor rows filed in several grid cells.
# A task takes 32 MB of a file or 16 MB of a shuffle however large the tables are: there are
# many shuffle partitions, which adaptive execution joins up again where they are small.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.autoBroadcastJoinThreshold": "16k",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.requireAllClusterKeysForCoPartition": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
    "spark.sql.session.timeZone": "UTC",
    # state on disk rather than in executors' memory; state of a processor of one's own needs it
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # texts may be long: smaller batches keep Python workers small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
}


def build(app: str = "sigtrace", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**TUNING, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession, **conf: str) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in {**TUNING, **conf}.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``; on a local master a temporary one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint that survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def in_place(df: DataFrame) -> DataFrame:
    """``df``, whose query may join it by more keys than it was shuffled by without another shuffle.

    Each row of it stands for several in a task, so a task takes less of the shuffle.  ``tune`` sets this back for the next query.
    """
    for key, value in IN_PLACE.items():
        df.sparkSession.conf.set(key, value)
    return df


IN_PLACE = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4000",
}
