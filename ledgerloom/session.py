"""Session helpers: building a session, checkpoint directory, numeric output rules."""
from __future__ import annotations

import gc
import os
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "ledgerloom", cpus: int | str = "*", shuffle_partitions: int = 8,
                  extra: dict | None = None) -> SparkSession:
    """Local session used by tests and the bench; a cluster passes its own session."""
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         # delete reliable checkpoint files once their RDDs are garbage collected
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.driver.memory", "8g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that one is used.  Only in
    local mode (tests) a folder under the warehouse directory is set when there is none; on a
    cluster a missing folder is an error, since executors share no local disk.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not conf_dir:
        wh = spark.conf.get("spark.sql.warehouse.dir")
        conf_dir = os.path.join(wh, "_checkpoints", uuid.uuid4().hex)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss; never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def free_shuffles(spark) -> None:
    """Asks for the removal of shuffle files that nothing refers to any more.

    Spark deletes them when the driver's garbage collector finds their plans unreachable, which
    on a quiet driver can take long; after a step has been written to a checkpoint its exchanges would lie on the executors' disks beside those of the next steps.

    The driver's Python gives up its hold on a plan in a thread of its own, a second later or more:
    large exchanges need :func:`passing_shuffles` besides."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def passing_shuffles(spark):
    """Spark removes the shuffle files of each query that is made and run inside as soon as it has ended."""
    old = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, old)


def r6(c: Column | str, digits: int = 6) -> Column:
    """Round a double for output; ``+ 0.0`` turns -0.0 into 0.0."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def sql_r6(expr: str, digits: int = 6) -> str:
    """The DuckDB twin of :func:`r6`."""
    return f"(ROUND(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def exact_sum(c: Column | str) -> Column:
    """Order-independent sum of a money column: accumulate as DECIMAL(38,7), return double.

    Double sums depend on the summation order (partitioning); amounts carry at most 7
    decimals, so the decimal sum is exact and identical on every run."""
    col = F.col(c) if isinstance(c, str) else c
    return F.sum(col.cast("decimal(38,7)")).cast("double")


class IterationState:
    """State of an iterative driver loop: every ``interval`` rounds the frame is written with a
    reliable checkpoint (cuts the lineage; short plans), the rounds between are persisted
    (memory, spilling to disk) and recomputed from at most ``interval`` rounds if a block is
    lost.  Measured locally, interval 1 is fastest (cached plans grow each round); a slow
    checkpoint store on a cluster can trade that for a larger interval."""

    def __init__(self, interval: int = 5):
        self.interval = max(int(interval), 1)
        self.round = 0
        self._live: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        from pyspark import StorageLevel
        self.round += 1
        if self.round % self.interval == 0:
            out = cut_lineage(df)
        else:
            out = df.persist(StorageLevel.MEMORY_AND_DISK)
            out.count()
        self._live.append(out)
        while len(self._live) > 2:          # the current and the previous round stay cached
            self._live.pop(0).unpersist()
        return out

    def release(self) -> None:
        for d in self._live:
            d.unpersist()
        self._live = []
