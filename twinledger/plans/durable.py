"""Reliable checkpoints, row numbers that do not need a single task, and size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names; make one up only for a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name below the shared checkpoint folder, for files to be read again."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add a broadcast hint to an already materialized table, but only after counting its rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def with_row_number(df: DataFrame, order_by: list[Column | str], name: str) -> DataFrame:
    """Number rows 1..n in the given order without pulling them into one task.

    Range-partition, sort inside partitions and checkpoint, so that each row's partition and place
    are fixed; then add the offset of the partition. The offsets are one row per partition, which
    is what bounds the broadcast and the window over them.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    place = f"__{name}_place"
    ordered = checkpointed(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    )
    part = F.shiftrightunsigned(F.col(place), 33)
    counts = ordered.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    numbered = ordered.withColumn("__part", part).join(F.broadcast(offsets), "__part", "left")
    within = F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn(name, F.col("__offset") + within + 1).drop("__part", "__offset", place)
