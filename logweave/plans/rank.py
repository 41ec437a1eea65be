"""Global row rank without a single-partition window.

``row_number() over (order by …)`` with no partition key pulls every row into
one task. Instead: range-partition on the order key (Spark samples the key
distribution, so a hot time range is split across tasks), sort inside each
partition, number rows within the partition, checkpoint (so the numbering is
stable if a task is re-run), then add the row count of all earlier partitions.
The offset table has one row per partition, a bound set by the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialize


def global_order(df: DataFrame, order_cols: list[str], num_partitions: int | None = None, ties: bool = False) -> DataFrame:
    """``df`` in range partitions that follow each other in the order, each sorted.

    ``ties`` says that rows may be equal in ``order_cols``: their order then
    is by a hash of the whole row, then by a running number, which also lets
    one value's rows spread over partitions. (Rows equal in all columns are
    interchangeable.)
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = list(order_cols)
    if ties:
        hashable = F.to_json(F.struct(*[F.col(c) for c in df.columns]))  # maps have no hash
        df = df.withColumn("__lw_hash", F.xxhash64(hashable)).withColumn("__lw_row", F.monotonically_increasing_id())
        places += ["__lw_hash", "__lw_row"]
    return df.repartitionByRange(n, *places).sortWithinPartitions(*places).drop("__lw_hash", "__lw_row")


def global_rank(
    df: DataFrame,
    order_cols: list[str],
    rank_col: str = "rank",
    total_col: str | None = None,
    num_partitions: int | None = None,
    ties: bool = False,
) -> DataFrame:
    """Add a 0-based ``rank_col`` in ``order_cols`` order.

    Ranks travel with their rows: ``df`` is shuffled and written once as it
    is, and never joined back, so equal rows stay apart. ``ties`` says that
    rows may be equal in ``order_cols`` (see :func:`global_order`).

    With ``total_col`` the total row count is added as well (no extra job).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ranged = (
        global_order(df, order_cols, num_partitions, ties)
        .withColumn("__lw_pid", F.spark_partition_id())
        .withColumn(
            "__lw_pos",
            F.monotonically_increasing_id() - F.shiftleft(F.col("__lw_pid").cast("long"), 33),
        )
    )
    ranged = materialize(ranged)  # numbering must not change if a task is re-run
    counts = ranged.groupBy("__lw_pid").agg(F.count(F.lit(1)).alias("__lw_n"))
    # one row per partition: a window over it is cheap and bounded by n
    w = Window.orderBy("__lw_pid")
    offsets = counts.select(
        "__lw_pid",
        F.coalesce(F.sum("__lw_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__lw_off"),
        F.sum("__lw_n").over(Window.partitionBy()).alias("__lw_total"),
    )
    out = ranged.join(F.broadcast(offsets), "__lw_pid").withColumn(rank_col, F.col("__lw_off") + F.col("__lw_pos"))
    if total_col:
        out = out.withColumnRenamed("__lw_total", total_col)
    return out.drop("__lw_pid", "__lw_pos", "__lw_off", "__lw_total")
