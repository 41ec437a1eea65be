"""Source → service → level flow edges and node totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import short_service
from ..session import materialize


def flow_level(level: F.Column) -> F.Column:
    up = F.upper(F.coalesce(level.cast("string"), F.lit("UNKNOWN")))
    return F.when(up.isin(*C.FLOW_LEVELS), up).otherwise(F.lit("OTHER"))


def _tagged(df: DataFrame) -> DataFrame:
    return df.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        short_service(F.coalesce(F.col("service").cast("string"), F.lit("unknown"))).alias("service"),
        flow_level(F.col("level")).alias("level"),
    )


def service_flow(df: DataFrame, multi: bool = True) -> DataFrame:
    """Edges (layer, src, dst, n): source→service and service→level.

    Counts are pre-aggregated once per (source, service, level); both edge
    layers roll up from that small table. ``multi=False`` leaves the source
    layer out (for a table of one source).
    """
    base = materialize(_tagged(df).groupBy("source", "service", "level").agg(F.count(F.lit(1)).alias("n")))
    sl = base.groupBy(F.col("service").alias("src"), F.col("level").alias("dst")).agg(F.sum("n").alias("n"))
    sl = sl.select(F.lit("service_level").alias("layer"), "src", "dst", "n")
    if not multi:
        return sl
    ss = base.groupBy(F.col("source").alias("src"), F.col("service").alias("dst")).agg(F.sum("n").alias("n"))
    return ss.select(F.lit("source_service").alias("layer"), "src", "dst", "n").unionByName(sl)


def flow_nodes(edges: DataFrame) -> DataFrame:
    """Node totals with their kind: sources by outflow, services and levels by inflow."""
    src_nodes = edges.where(F.col("layer") == "source_service").groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("n"))
    svc_nodes = edges.where(F.col("layer") == "service_level").groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("n"))
    lvl_nodes = edges.where(F.col("layer") == "service_level").groupBy(F.col("dst").alias("node")).agg(F.sum("n").alias("n"))
    return (
        src_nodes.select(F.lit("source").alias("kind"), "node", "n")
        .unionByName(svc_nodes.select(F.lit("service").alias("kind"), "node", "n"))
        .unionByName(lvl_nodes.select(F.lit("level").alias("kind"), "node", "n"))
    )
