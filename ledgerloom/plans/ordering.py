"""Global order without a single partition.

A bare ``Window.orderBy`` (no partition key) moves every row into one task.  These helpers
rank rows in a total order with a range shuffle instead:

1. ``repartitionByRange(P, order)`` + ``sortWithinPartitions(order)`` (P explicit, so AQE
   does not coalesce it and partition ids stay stable);
2. local position = ``monotonically_increasing_id() - (partition_id << 33)`` (assigned in the
   sorted iteration order, deterministic because the order is total);
3. per-partition counts (P rows) -> prefix offsets, broadcast (size bound: P rows);
4. rank = offset + local position.

The range partitioner samples its bounds with a seed tied to the RDD, so two plans over the
same input may cut different bounds.  The sorted frame is therefore written once with a
reliable checkpoint (``spark.checkpoint.dir``) and both the counts and the rows read it;
this also cuts the lineage, so a lost executor does not re-sample.

The order columns must form a total order (add a unique tie-break column).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


_TARGET_BYTES = 128 * 1024 * 1024
_UNKNOWN = 1 << 60
_ROW_GROWTH = 16        # rows in memory against files on disk, and rows that joins add


def _leaf_bytes(spark: SparkSession, leaf) -> int:
    """What a leaf of a plan holds: the size of its files if it is a checkpoint, which keeps the
    estimate of the plan it was made by (a product of the sides for a join), else its estimate."""
    if leaf.nodeName().startswith("LogicalRDD"):
        file = leaf.rdd().getCheckpointFile()
        if file.isDefined():
            path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
            return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return int(str(leaf.stats().sizeInBytes()))


def _num_partitions(df: DataFrame, num_partitions: int | None) -> int:
    """Explicit count, else about one range partition per 128 MB of the optimizer's size
    estimate, at least the default parallelism, without an upper bound (an explicit count is
    never coalesced by AQE, so it is sized here).  Estimates of joins multiply and can be far
    too large; they are then bounded by what the leaves hold."""
    if num_partitions:
        return int(num_partitions)
    spark = df.sparkSession
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    read = sum(_leaf_bytes(spark, leaves.apply(i)) for i in range(leaves.size()))
    if read >= _UNKNOWN:        # a leaf without an estimate
        return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = min(int(str(plan.stats().sizeInBytes())), _ROW_GROWTH * max(read, 1))
    return int(max(spark.sparkContext.defaultParallelism, -(-size // _TARGET_BYTES)))


def with_global_rank(df: DataFrame, order_cols: list[str | Column], rank_col: str = "_rank",
                     num_partitions: int | None = None) -> DataFrame:
    """Append a 0-based global rank in ``order_cols`` order (ties broken by the order itself)."""
    p = _num_partitions(df, num_partitions)
    s = df.repartitionByRange(p, *order_cols).sortWithinPartitions(*order_cols)
    s = (s.withColumn("_pid", F.spark_partition_id())
          .withColumn("_local", F.monotonically_increasing_id()
                      - F.shiftleft(F.col("_pid").cast("long"), 33)))
    s = cut_lineage(s)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    offs = counts.select("_pid", (F.sum("_cnt").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"))
    offs = offs.fillna({"_off": 0})
    return (s.join(F.broadcast(offs), "_pid")
            .withColumn(rank_col, F.col("_off") + F.col("_local"))
            .drop("_pid", "_local", "_off"))


def with_cumulative_sums(df: DataFrame, order_cols: list[str | Column], value_cols: list[str],
                         prefix: str = "cum_", num_partitions: int | None = None,
                         partition_cols: list[str] = ()) -> DataFrame:
    """Running sums of ``value_cols`` in a total order (inclusive of the current row), per
    ``partition_cols`` group when given (the group's offset - the global running sum just before
    its first row - is a grouped min, so a huge group is never one task).

    Same scheme as :func:`with_global_rank`: range partitions written once (checkpoint),
    per-partition totals -> broadcast prefix offsets (P rows), running sums inside each range
    partition.  No single-partition window over the rows."""
    if partition_cols:
        full = [*(F.col(c) for c in partition_cols), *order_cols]
        g = with_cumulative_sums(df, full, value_cols, prefix, num_partitions)
        first_key = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order_cols])
        first = g.groupBy(*partition_cols).agg(*[F.min_by(F.col(f"{prefix}{v}") - F.col(v), first_key).alias(f"_g_{v}")
                                                 for v in value_cols])
        g = g.join(first, list(partition_cols))
        for v in value_cols:
            g = g.withColumn(f"{prefix}{v}", F.col(f"{prefix}{v}") - F.col(f"_g_{v}"))
        return g.drop(*[f"_g_{v}" for v in value_cols])
    p = _num_partitions(df, num_partitions)
    s = df.repartitionByRange(p, *order_cols).sortWithinPartitions(*order_cols) \
        .withColumn("_pid", F.spark_partition_id())
    s = cut_lineage(s)
    totals = s.groupBy("_pid").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    prev = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select("_pid", *[F.coalesce(F.sum(f"_t_{v}").over(prev), F.lit(0)).alias(f"_o_{v}")
                                   for v in value_cols])
    w = Window.partitionBy("_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    out = s.join(F.broadcast(offs), "_pid")
    for v in value_cols:
        out = out.withColumn(f"{prefix}{v}", F.col(f"_o_{v}") + F.sum(v).over(w))
    return out.drop("_pid", *[f"_o_{v}" for v in value_cols])


def exact_percentiles(df: DataFrame, value_col: str, qs: dict[str, float],
                      num_partitions: int | None = None, interpolation: str = "linear") -> DataFrame:
    """One row with the exact linear-interpolated percentile of ``value_col`` for each q.

    Same definition as ``percentile``/pandas ``quantile``: pos = (n-1) q, interpolate between
    the values at ranks floor(pos) and ceil(pos).  Nulls are ignored.  All quantiles come from one
    pass over the distinct values.
    """
    v = df.select(F.col(value_col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    # equal values are one row with their number, so a frequent value is no large task
    g = with_cumulative_sums(v.groupBy("_v").agg(F.count(F.lit(1)).alias("_c")), [F.col("_v")], ["_c"],
                             num_partitions=num_partitions)
    n = F.broadcast(g.agg(F.max("cum__c").alias("_n")))
    holds = lambda rank: (rank < F.col("cum__c")) & (rank >= F.col("cum__c") - F.col("_c"))
    at = {name: (F.col("_n") - 1) * F.lit(float(q)) for name, q in qs.items()}
    picks = [F.max(F.when(holds(end(pos)), F.col("_v"))).alias(f"{side}{i}")
             for i, pos in enumerate(at.values()) for side, end in (("lo", F.floor), ("hi", F.ceil))]
    one = g.crossJoin(n).agg(F.max("_n").alias("_n"), *picks)      # one row, also for no values
    if interpolation == "lower":
        return one.select(*[F.col(f"lo{i}").alias(name) for i, name in enumerate(at)])
    return one.select(*[(F.col(f"lo{i}") + (pos - F.floor(pos)) * (F.col(f"hi{i}") - F.col(f"lo{i}"))).alias(name)
                        for i, (name, pos) in enumerate(at.items())])


def grouped_percentiles(df: DataFrame, group_col: str, value_col: str, qs: dict[str, float],
                        num_partitions: int | None = None) -> DataFrame:
    """One row per group with the exact linear-interpolated percentiles of its values (as
    :func:`exact_percentiles`), for all groups and quantiles in one range-partitioned pass.

    Equal values of a group are one row with their number; their running numbers over the order
    (group, value) come from one range exchange, a group's own start is a grouped minimum, so
    neither a large group nor a frequent value is a task of its own.  Null values are ignored."""
    v = df.select(F.col(group_col), F.col(value_col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    g = with_cumulative_sums(v.groupBy(group_col, "_v").agg(F.count(F.lit(1)).alias("_c")),
                             [F.col(group_col), F.col("_v")], ["_c"], num_partitions=num_partitions)
    size = g.groupBy(group_col).agg(F.min(F.col("cum__c") - F.col("_c")).alias("_from"), F.sum("_c").alias("_n"))
    g = g.join(size, group_col).withColumn("_upto", F.col("cum__c") - F.col("_from"))
    holds = lambda rank: (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_c"))
    at = {name: (F.col("_n") - 1) * F.lit(float(q)) for name, q in qs.items()}
    picks = [F.max(F.when(holds(end(pos)), F.col("_v"))).alias(f"{side}{i}")
             for i, pos in enumerate(at.values()) for side, end in (("lo", F.floor), ("hi", F.ceil))]
    one = g.groupBy(group_col).agg(F.max("_n").alias("_n"), *picks)
    return one.select(group_col, *[(F.col(f"lo{i}") + (pos - F.floor(pos)) * (F.col(f"hi{i}") - F.col(f"lo{i}"))).alias(name)
                                   for i, (name, pos) in enumerate(at.items())])


def windowed(df: DataFrame, partition_cols: list[str], order_cols: list[str | Column],
             before: int, after: int, build, chunk_rows: int = 1 << 22) -> DataFrame:
    """Frame/lag/lead computations over ``partition_cols`` ordered by ``order_cols`` without
    a task per partition key.

    Rows get a global rank in (partition, order) order and are cut into chunks of
    ``chunk_rows`` consecutive rows.  Rows within ``after`` of a chunk start are copied into
    the previous chunk and rows within ``before`` of a chunk end into the next one (halo), so
    a window ``partitionBy(partition_cols + chunk).orderBy(rank)`` sees every neighbour a
    frame ``rowsBetween(-before, after)`` needs.  Only the home copies are returned.

    ``build(w)`` receives that WindowSpec and returns a list of Columns to add.
    Each window task holds at most ``chunk_rows + before + after`` rows, whatever the key skew.
    """
    if before > chunk_rows or after > chunk_rows:
        raise ValueError("frame larger than a chunk")
    keys = list(partition_cols)
    r = with_global_rank(df, [*(F.col(c) for c in keys), *order_cols], "_g")
    r = r.withColumn("_chunk", F.floor(F.col("_g") / chunk_rows))
    pos = F.col("_g") - F.col("_chunk") * chunk_rows
    parts = [r.withColumn("_home", F.lit(True))]
    if after > 0:
        parts.append(r.where(pos < after).withColumn("_chunk", F.col("_chunk") - 1)
                     .withColumn("_home", F.lit(False)))
    if before > 0:
        parts.append(r.where(pos >= chunk_rows - before).withColumn("_chunk", F.col("_chunk") + 1)
                     .withColumn("_home", F.lit(False)))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    w = Window.partitionBy(*keys, "_chunk").orderBy("_g")
    cols = build(w)
    return u.select("*", *cols).where(F.col("_home")).drop("_home", "_chunk")
