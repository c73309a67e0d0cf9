"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators are tuned for; results do not depend on them, except
#: the time zone, which the event-time arithmetic assumes.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # lets row_number() <= k prune before the shuffle for the k used here
    "spark.sql.optimizer.windowGroupLimitThreshold": "65536",
    # the stateful streaming jobs need it
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.checkpoint.compress": "true",
}


#: Whether the shuffle files of a query go when it ends.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits of a size estimate, in bytes, that can be taken seriously.
_MOST_BITS = 62


def build_session(app: str = "flowsift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with :data:`DEFAULTS`; ``conf`` overrides (dots as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        shared = tempfile.mkdtemp(prefix="flowsift-ckpt-")
    context.setCheckpointDir(shared)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run in here leave no shuffle files; a frame that is run later must be made outside."""
    before = spark.conf.get(_CLEAN_UP)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN_UP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: partitions and row order survive executor loss.

    Used where two later steps must see *the same* partitioning (range
    boundaries are sampled, so recomputing them could move rows).

    A checkpoint keeps the size estimate of the plan that it cuts, and a join
    multiplies the estimates of its sides: in a loop the number's digits double
    with every round, until planning takes longer than the work.  An estimate
    beyond any real size is therefore dropped: the frame is made anew from its
    rows.

    The shuffle files behind a checkpoint are not needed any more; they go at
    once and not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    _ensure_checkpoint_dir(spark)
    with shuffles_dropped(spark):
        cut = df.select("*").checkpoint(eager=True)  # a plan of its own: what else uses df keeps its shuffles
    plan = cut._jdf.queryExecution()
    if int(plan.optimizedPlan().stats().sizeInBytes()).bit_length() <= _MOST_BITS:
        return cut
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), cut._jdf.schema(), False), spark)
