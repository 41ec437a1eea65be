"""Event time, event classes, lanes, density, anomaly windows, downsampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import jre, usable_pattern
from ..plans.rank import global_rank

# Formats tried for every row (first that parses wins). Naive times are UTC.
# One-digit fields, a slash date and the compact HHmm are accepted by the line formats too.
TIME_FORMATS = [
    "y-M-d H:m:s[.SSSSSSSSS][,SSSSSSSSS][XXX][X]",
    "y-M-d'T'H:m:s[.SSSSSSSSS][,SSSSSSSSS][XXX][X]",
    "y-M-d H:m[XXX][X]",
    "y-M-d'T'H:m[XXX][X]",
    "y-M-d HHmm[ss]",
    "y-M-d'T'HHmm[ss]",
    "y-M-d",
    "y/M/d H:m:s[.SSSSSSSSS][,SSSSSSSSS]",
    "y/M/d H:m",
    "y/M/d",
]


def event_time(
    time_col: Column,
    base_date: str | None = None,
    extra_formats: list[str] | tuple[str, ...] = (),
) -> Column:
    """Parse a log time string into a timestamp (NULL if no format fits).

    ``base_date`` ('yyyy-MM-dd') dates time-only values (``HH:mm:ss[.SSS]``);
    without it they stay NULL. ``extra_formats`` adds e.g. the access-log
    format ``dd/MMM/yyyy:HH:mm:ss Z``.
    """
    parsed = [F.try_to_timestamp(time_col, F.lit(f)) for f in list(TIME_FORMATS) + list(extra_formats)]
    if base_date is not None:
        parsed.append(
            F.try_to_timestamp(F.concat(F.lit(base_date + " "), time_col), F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][,SSSSSSSSS]"))
        )
    return F.coalesce(*parsed)


def with_event_time(
    df: DataFrame,
    time_col: str = "time",
    ts_col: str = "ts",
    include_untimed: bool = True,
    base_date: str | None = None,
    extra_formats: list[str] | tuple[str, ...] = (),
) -> DataFrame:
    """Add ``ts`` and drop rows whose time does not parse.

    ``include_untimed=False`` also drops the 1970 placeholder of lines without a time.
    """
    out = df.withColumn(ts_col, event_time(F.col(time_col), base_date, extra_formats)).where(F.col(ts_col).isNotNull())
    if not include_untimed:
        out = out.where(F.col(time_col) != F.lit(C.DEFAULT_TIME))
    return out


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1_000_000.0)


def floor_minutes(ts: Column, minutes: int) -> Column:
    """Epoch-aligned floor of a timestamp to ``minutes``."""
    width = int(minutes) * 60_000_000
    return F.timestamp_micros(F.floor(F.unix_micros(ts) / F.lit(width)).cast("long") * F.lit(width))


# ── event classes ──────────────────────────────────────────────────────────

def _type_condition(et: C.EventType, msg: Column, level: Column) -> Column | None:
    conds = []
    for code in et.status_codes:
        p = rf"\b{code}\b"
        if usable_pattern(p):
            conds.append(msg.rlike(jre(p)))
    for kw in et.keywords:
        if usable_pattern(kw):
            conds.append(msg.rlike(jre(kw, ignore_case=True)))
    if et.levels:
        conds.append(F.upper(level).isin(*et.levels))
    if not conds:
        return None
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return F.coalesce(out, F.lit(False))


def event_types(custom: list[C.EventType] | None = None) -> list[C.EventType]:
    return list(custom or []) + list(C.DEFAULT_EVENT_TYPES)


def classify_event(
    df: DataFrame,
    custom_types: list[C.EventType] | None = None,
    msg_col: str = "msg",
    level_col: str = "level",
    out_col: str = "event_type",
    display_col: str | None = "event_display",
) -> DataFrame:
    """First event type (custom ones first) whose code, keyword or level matches; else catch-all."""
    types = event_types(custom_types)
    msg = F.coalesce(F.col(msg_col).cast("string"), F.lit(""))
    level = F.coalesce(F.col(level_col).cast("string"), F.lit(""))
    catch = next((t for t in types if t.catch_all), C.DEFAULT_EVENT_TYPES[-1])
    # one struct per type: a custom type may reuse a default type's name with a display of its own
    both = lambda t: F.struct(F.lit(t.name).alias("name"), F.lit(t.display).alias("display"))
    chain = F
    for et in types:
        cond = _type_condition(et, msg, level)
        if cond is not None:
            chain = chain.when(cond, both(et))
    chosen = both(catch) if chain is F else chain.otherwise(both(catch))
    out = df.withColumn("__lw_type", chosen).withColumn(out_col, F.col("__lw_type.name"))
    if display_col:
        out = out.withColumn(display_col, F.col("__lw_type.display"))
    return out.drop("__lw_type")


def is_anomaly_type(event_type: Column) -> Column:
    return event_type.isin(*C.ANOMALY_ERROR_TYPES)


# ── lanes ──────────────────────────────────────────────────────────────────

def assign_lane(
    df: DataFrame,
    rules: list[C.LaneRule] | None = None,
    mode: str = "service",
    out_col: str = "lane",
) -> DataFrame:
    """Lane = first matching rule's name (case-insensitive regex on msg), else by mode."""
    has_source = "source" in df.columns
    msg = F.coalesce(F.col("msg").cast("string"), F.lit(""))
    service = F.coalesce(F.col("service").cast("string"), F.lit("unknown"))
    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if has_source else F.lit("")
    prefixed = has_source and mode in ("source", "source_service")
    if not has_source or mode == "service":
        default = service
    elif mode == "source":
        default = source
    else:
        default = F.concat(source, F.lit(" › "), service)
    expr = None
    for r in rules or []:
        if not usable_pattern(r.pattern):
            continue
        name = F.concat(source, F.lit(" › "), F.lit(r.lane_name)) if prefixed else F.lit(r.lane_name)
        cond = F.coalesce(msg.rlike(jre(r.pattern, ignore_case=True)), F.lit(False))
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return df.withColumn(out_col, default if expr is None else expr.otherwise(default))


# ── timeline tables ────────────────────────────────────────────────────────

def classified_timeline(
    df: DataFrame,
    event_types: Sequence[C.EventType] = (),
    lane_rules: Sequence[C.LaneRule] = (),
    lane_mode: str = "service",
    **time_kw,
) -> DataFrame:
    """Timed rows with lane and event class: the frame every timeline table reads. Every row is in it."""
    timed = with_event_time(df, **time_kw)
    laned = assign_lane(timed, list(lane_rules), lane_mode)
    return classify_event(laned, list(event_types))


def timeline_points(df: DataFrame, keep: tuple[str, ...] = (), **timeline_kw) -> DataFrame:
    """One point per timed row: the ``keep`` columns, ts, lane, event_type, event_display, level, msg."""
    return classified_timeline(df, **timeline_kw).select(*keep, "ts", "lane", "event_type", "event_display", "level", "msg")


def downsample_every(df: DataFrame, step: int, order_cols: list[str]) -> DataFrame:
    """A sample: every ``step``-th row in the order of ``order_cols``, the first one included.

    Rows equal in the order columns each have a place of their own.
    """
    if step <= 1:
        return df
    ranked = global_rank(df, order_cols, rank_col="__lw_rank", ties=True)
    return ranked.where(F.col("__lw_rank") % step == 0).drop("__lw_rank")


def downsample(df: DataFrame, order_cols: list[str], max_points: int = 3000) -> DataFrame:
    """A sample for a chart: every (rows // ``max_points``)-th row; all rows up to ``max_points``.

    The step comes from the ranks' own total, so the rows are read once.
    """
    ranked = global_rank(df, order_cols, rank_col="__lw_rank", total_col="__lw_rows", ties=True)
    step = F.greatest(F.floor(F.col("__lw_rows") / F.lit(int(max_points))), F.lit(1))
    return ranked.where(F.col("__lw_rank") % step == 0).drop("__lw_rank", "__lw_rows")


def sampled_density(classified: DataFrame, order_cols: list[str], max_points: int = 3000, bucket_minutes: int = 5, hot_share: float = 0.4) -> DataFrame:
    """:func:`event_density` of the rows that :func:`downsample` draws for the chart above it."""
    return event_density(downsample(classified, order_cols, max_points), bucket_minutes, hot_share)


def event_density(classified: DataFrame, bucket_minutes: int = 5, hot_share: float = 0.4) -> DataFrame:
    """Rows per time bucket; ``hot`` when the error share reaches ``hot_share``."""
    b = floor_minutes(F.col("ts"), bucket_minutes).alias("bucket")
    return (
        classified.groupBy(b)
        .agg(F.count(F.lit(1)).alias("events"), F.count_if(is_anomaly_type(F.col("event_type"))).alias("errors"))
        .withColumn("hot", F.col("errors") / F.col("events") >= F.lit(hot_share))
    )


def anomaly_buckets(classified: DataFrame, window_minutes: int = 10, threshold: float = 0.5) -> DataFrame:
    """Per window bucket: total, errors, rate; only buckets with rate ≥ threshold."""
    width = int(window_minutes) * 60_000_000
    return (
        classified.groupBy(F.floor(F.unix_micros("ts") / F.lit(width)).cast("long").alias("bucket_index"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(is_anomaly_type(F.col("event_type"))).alias("errors"))
        .withColumn("rate", F.col("errors") / F.col("total"))
        .where(F.col("rate") >= F.lit(threshold))
        .withColumn("bucket", F.timestamp_micros(F.col("bucket_index") * F.lit(width)))
    )


def anomaly_label(start: Column, end: Column) -> Column:
    head, rest = C.ANOMALY_LABEL.split("{start}")
    mid, tail = rest.split("{end}")
    return F.concat(F.lit(head), F.date_format(start, "HH:mm"), F.lit(mid), F.date_format(end, "HH:mm"), F.lit(tail))


def anomaly_windows(classified: DataFrame, window_minutes: int = 10, threshold: float = 0.5) -> DataFrame:
    """Merge bad buckets one window apart into (start, end, label) — gaps and islands.

    Island id = bucket index − its global rank among bad buckets (consecutive
    buckets share it); the rank comes from the range-partitioned helper, so no
    step needs all buckets in one task.
    """
    width = int(window_minutes) * 60_000_000
    bad = anomaly_buckets(classified, window_minutes, threshold).select("bucket_index")
    # one row per bad time bucket (years of minutes are a few million rows): a
    # handful of range partitions is plenty
    n = min(32, int(classified.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranked = global_rank(bad, ["bucket_index"], rank_col="__lw_r", num_partitions=n)
    isl = ranked.groupBy((F.col("bucket_index") - F.col("__lw_r")).alias("__lw_island")).agg(
        F.min("bucket_index").alias("k0"), F.max("bucket_index").alias("k1")
    )
    start = F.timestamp_micros(F.col("k0") * F.lit(width))
    end = F.timestamp_micros((F.col("k1") + 1) * F.lit(width))
    label = anomaly_label(start, end)
    return isl.select(start.alias("start"), end.alias("end"), label.alias("label"), (F.col("k1") - F.col("k0") + 1).alias("buckets"))


def lane_axis(classified: DataFrame) -> DataFrame:
    """Distinct lanes in reverse name order (top to bottom of the chart)."""
    return classified.select("lane").distinct().orderBy(F.col("lane").desc())
