"""Edge-table filters, weights, summaries and graph checks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.assets import asset_edge_type
from ..plans.ordering import grouped_percentiles, with_global_rank
from ..session import cut_lineage, exact_sum
from .features import endpoints

DAY = 86400


# ----------------------------------------------------------------------------- filters

def filter_transactions(edges: DataFrame, from_account=None, to_account=None,
                        asset=None) -> DataFrame:
    """any subset of from / to / asset equality filters (pushed down to the scan)."""
    cond = F.lit(True)
    if from_account is not None:
        cond = cond & (F.col("src") == F.lit(from_account))
    if to_account is not None:
        cond = cond & (F.col("dst") == F.lit(to_account))
    if asset is not None:
        cond = cond & (F.col("asset") == F.lit(asset))
    return edges.where(cond)


def filter_normalized(tx: DataFrame, start=None, end=None, accounts: list | None = None,
                      ts_col: str = "ts") -> DataFrame:
    """inclusive time range, account list on either side, drop null/empty endpoints,
    null amount -> 0."""
    cond = (F.col("src").isNotNull() & (F.col("src") != "")
            & F.col("dst").isNotNull() & (F.col("dst") != ""))
    if start is not None:
        cond = cond & (F.col(ts_col) >= F.lit(start))
    if end is not None:
        cond = cond & (F.col(ts_col) <= F.lit(end))
    if accounts:
        cond = cond & (F.col("src").isin(list(accounts)) | F.col("dst").isin(list(accounts)))
    return tx.where(cond).withColumn("amount", F.coalesce(F.col("amount"), F.lit(0.0)))


def window_slice(edges: DataFrame, start, end) -> DataFrame:
    """edges with start <= ts <= end (inclusive both ends); start > end is an error."""
    if start is not None and end is not None and start > end:
        raise ValueError("start must be <= end")
    return edges.where(F.col("ts").between(F.lit(start), F.lit(end)))


def window_nodes(edges: DataFrame) -> DataFrame:
    """Distinct endpoints of an edge set."""
    return endpoints(edges).select("node").distinct()


def last_n_days(edges: DataFrame, now, days: int) -> DataFrame:
    """start = max(0, now - days*86400 + 1), end = now; days >= 1."""
    if days < 1:
        raise ValueError("days must be >= 1")
    nowc = now if isinstance(now, Column) else F.lit(now)
    start = F.greatest(F.lit(0), nowc - F.lit(days * DAY) + 1)
    return edges.where((F.col("ts") >= start) & (F.col("ts") <= nowc))


def with_edge_type(edges: DataFrame, asset_col: str = "asset") -> DataFrame:
    """F8: edge_type 0 (XLM), 1 (stablecoin code), 2 (other)."""
    return edges.withColumn("edge_type", asset_edge_type(F.col(asset_col)))


# ----------------------------------------------------------------------------- weights, graph

_AGGS = {
    "sum": lambda c: exact_sum(c),
    "mean": lambda c: exact_sum(c) / F.count(F.lit(1)),
    "count": lambda c: F.count(F.lit(1)).cast("double"),
    "max": lambda c: F.max(c),
    "min": lambda c: F.min(c),
}


def edge_weights(edges: DataFrame, aggregation: str = "sum", by_asset: bool = False,
                 drop_self_loops: bool = True) -> DataFrame:
    """Weight per (src, dst[, asset]) with sum / mean / count / max / min.

    The transaction graph drops self-loops (D1).  Pairs never seen have weight 0.0 (callers
    left-join to this table and ``coalesce(weight, 0.0)``).
    """
    if aggregation not in _AGGS:
        raise ValueError(f"unknown aggregation {aggregation!r}")
    e = edges.where(F.col("src") != F.col("dst")) if drop_self_loops else edges
    keys = ["src", "dst"] + (["asset"] if by_asset else [])
    return e.groupBy(*keys).agg(_AGGS[aggregation](F.col("amount").cast("double")).alias("weight"))


def weighted_graph(edges: DataFrame, aggregation: str = "sum", asset=None) -> DataFrame:
    """Simple weighted digraph export: weight, transaction_count and the edge_type of the
    first transaction (by ts, edge_id).  The per-pair transaction list is a separate long table
    (:func:`weighted_graph_transactions`) - one busy pair must not become one huge array."""
    e = edges.where(F.col("src") != F.col("dst"))
    if asset is not None:
        e = e.where(F.col("asset") == F.lit(asset))
    e = with_edge_type(e)
    order = F.struct("ts", "edge_id")
    return e.groupBy("src", "dst").agg(
        _AGGS[aggregation](F.col("amount").cast("double")).alias("weight"),
        F.count(F.lit(1)).alias("transaction_count"),
        F.min_by("edge_type", order).alias("edge_type"))


def weighted_graph_transactions(edges: DataFrame, asset=None) -> DataFrame:
    """G8 metadata: (src, dst, edge_id, position) - the transactions of each pair in (ts,
    edge_id) order.  Positions come from a range-partitioned global rank minus the pair's first
    rank (a grouped min), so a pair with a third of all rows is spread over many tasks."""
    from ..plans.ordering import with_global_rank
    e = edges.where(F.col("src") != F.col("dst"))
    if asset is not None:
        e = e.where(F.col("asset") == F.lit(asset))
    r = with_global_rank(e.select("src", "dst", "ts", "edge_id"), ["src", "dst", "ts", "edge_id"], "_g")
    first = r.groupBy("src", "dst").agg(F.min("_g").alias("_g0"))
    return r.join(first, ["src", "dst"]).select("src", "dst", "edge_id", (F.col("_g") - F.col("_g0")).alias("position"))


def graph_summary(edges: DataFrame) -> DataFrame:
    """Node count, distinct pair count, transaction count, asset count (self-loops dropped)."""
    e = edges.where(F.col("src") != F.col("dst"))
    nodes = endpoints(e).agg(F.count_distinct("node").alias("node_count"))
    rest = e.agg(F.count(F.lit(1)).alias("transaction_count"),
                 F.count_distinct("src", "dst").alias("edge_count"),
                 F.count_distinct("asset").alias("asset_count"))
    return nodes.crossJoin(rest)


def asset_transaction_counts(edges: DataFrame) -> DataFrame:
    """Transactions per asset."""
    return (edges.where(F.col("src") != F.col("dst")).groupBy("asset")
            .agg(F.count(F.lit(1)).alias("transaction_count")))


def graph_statistics(edges: DataFrame, weight_col: str | None = "amount") -> DataFrame:
    """One row of edge/node counts, density E/(N(N-1)), degree and weight statistics.

    Medians are exact (linear interpolation) via a range-partitioned rank, not a global sort
    in one task.  Degree = out + in count per node.
    """
    deg = cut_lineage(endpoints(edges).groupBy("node").agg(F.count(F.lit(1)).alias("deg")))
    counts = edges.agg(F.count(F.lit(1)).alias("num_edges"),
                       F.count_distinct("src").alias("num_source_nodes"),
                       F.count_distinct("dst").alias("num_target_nodes"),
                       *([F.min(weight_col).cast("double").alias("weight_min"), F.max(weight_col).cast("double").alias("weight_max"),
                          F.avg(F.col(weight_col).cast("double")).alias("weight_mean"),
                          F.stddev_samp(F.col(weight_col).cast("double")).alias("weight_std"),
                          exact_sum(weight_col).alias("weight_sum")] if weight_col else []))
    dstats = deg.agg(F.count(F.lit(1)).alias("num_nodes"),
                     F.avg("deg").alias("avg_degree"), F.min("deg").alias("degree_min"),
                     F.max("deg").alias("degree_max"), F.stddev_samp("deg").alias("degree_std"))
    # both medians from one pass over (measure, value)
    values = deg.select(F.lit("degree").alias("measure"), F.col("deg").cast("double").alias("value"))
    if weight_col:
        values = values.unionByName(edges.select(F.lit("weight").alias("measure"), F.col(weight_col).cast("double").alias("value")))
    medians = grouped_percentiles(values, "measure", "value", {"median": 0.5})
    pick = lambda m: F.max(F.when(F.col("measure") == m, F.col("median"))).alias(f"{m}_median")
    out = counts.crossJoin(dstats).crossJoin(medians.agg(*[pick(m) for m in ["degree"] + (["weight"] if weight_col else [])]))
    return out.withColumn("density", F.when(F.col("num_nodes") > 1, F.col("num_edges")
                                            / (F.col("num_nodes") * (F.col("num_nodes") - 1)))
                          .otherwise(F.lit(0.0)))


def isolated_nodes(all_nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of ``all_nodes(node)`` that are endpoints of no edge (anti join)."""
    return all_nodes.select("node").distinct().join(endpoints(edges).select("node"), "node",
                                                    "left_anti")


def edge_consistency(edges: DataFrame, weight_col: str | None = "amount") -> DataFrame:
    """Q9: counts of null endpoints (error), self-loops, duplicate (src,dst) rows and
    negative weights (warnings).  duplicates = rows - distinct pairs."""
    aggs = [F.count(F.lit(1)).alias("num_edges"),
            F.sum(F.when(F.col("src").isNull() | F.col("dst").isNull(), 1).otherwise(0))
             .alias("null_endpoints"),
            F.sum(F.when(F.col("src") == F.col("dst"), 1).otherwise(0)).alias("self_loops"),
            F.count_distinct("src", "dst").alias("distinct_pairs")]
    if weight_col:
        aggs.append(F.sum(F.when(F.col(weight_col) < 0, 1).otherwise(0)).alias("negative_weights"))
    r = edges.agg(*aggs)
    nn = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).agg(
        F.count(F.lit(1)).alias("_nn"))
    return (r.crossJoin(nn).withColumn("duplicate_edges", F.col("_nn") - F.col("distinct_pairs"))
            .drop("_nn"))


def validate_graph(edges: DataFrame, all_nodes: DataFrame | None = None,
                   allow_self_loops: bool = True, allow_duplicates: bool = False) -> DataFrame:
    """Q10: one row: consistency counts, isolated count, summary and a ``passed`` flag."""
    c = edge_consistency(edges)
    if all_nodes is not None:
        iso = isolated_nodes(all_nodes, edges).agg(F.count(F.lit(1)).alias("isolated_nodes"))
    else:
        iso = edges.sparkSession.range(1).select(F.lit(0).cast("long").alias("isolated_nodes"))
    s = graph_statistics(edges, None).select("num_nodes", "density", "avg_degree")
    out = c.crossJoin(iso).crossJoin(s)
    ok = F.col("null_endpoints") == 0
    if not allow_self_loops:
        ok = ok & (F.col("self_loops") == 0)
    if not allow_duplicates:
        ok = ok & (F.col("duplicate_edges") == 0)
    return out.withColumn("passed", ok)


def top_k_per_metric(metrics: DataFrame, id_col: str, metric_cols: list[str],
                     k: int = 10) -> DataFrame:
    """Top-k ids per metric (descending, ties by id).  Unpivot, then a window partitioned
    by metric with ``row_number <= k``; Spark plans this as a per-partition top-k
    (WindowGroupLimit) before the shuffle, so only k rows per metric and partition move."""
    from pyspark.sql import Window
    long_ = metrics.unpivot(id_col, metric_cols, "metric", "value")
    w = Window.partitionBy("metric").orderBy(F.col("value").desc(), F.col(id_col))
    return (long_.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))


def metric_summary(metrics: DataFrame, id_col: str, metric_cols: list[str]) -> DataFrame:
    """Per metric: mean, std (sample), min, max, exact median, non-zero count."""
    long_ = metrics.unpivot(id_col, metric_cols, "metric", "value") \
        .withColumn("value", F.col("value").cast("double"))
    base = long_.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.sum(F.when(F.col("value") != 0, 1).otherwise(0)).alias("non_zero"))
    return base.join(grouped_percentiles(long_, "metric", "value", {"median": 0.5}), "metric", "left")


def account_timeline(edges: DataFrame, account: str, direction: str = "all", since=None, until=None,
                     assets: list[str] | None = None, filters: dict[str, list] | None = None) -> DataFrame:
    """activity of one account, inbound, outbound or all, in a time window, by asset and by
    the values of further columns (type, status), with its ``replay`` position: (ts, edge_id)
    order, a global rank, since one account may hold a large part of the edges."""
    if direction not in ("all", "inbound", "outbound"):
        raise ValueError("direction must be all, inbound or outbound")
    out, in_ = F.col("src") == account, F.col("dst") == account
    e = edges.where({"all": out | in_, "inbound": in_, "outbound": out}[direction])
    if since is not None:
        e = e.where(F.col("ts") >= since)
    if until is not None:
        e = e.where(F.col("ts") <= until)
    for column, values in {**({"asset": assets} if assets is not None else {}), **(filters or {})}.items():
        e = e.where(F.col(column).isin(list(values)))
    e = e.withColumn("direction", F.when(out, "outbound").otherwise("inbound"))
    return with_global_rank(e, ["ts", "edge_id"], "replay")
