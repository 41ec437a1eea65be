"""Filters, search, preview and totals over the processed log table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jre
from ..plans.rank import global_rank

PREVIEW_COLUMNS = ["time", "level", "service", "msg", "redacted_entities", "source"]


def filter_level(df: DataFrame, level: str | None, normalised: bool = False) -> DataFrame:
    """Rows of one level (case-insensitive); ``None`` or 'ALL' keeps everything.

    ``normalised=True`` states that levels are already upper case, as
    ``parse_logs`` writes them; the plain equality then reaches the parquet
    scan as a pushed filter (and prunes partitions of a level-partitioned table).
    """
    if level is None or level.upper() == "ALL":
        return df
    if normalised:
        return df.where(F.col("level") == F.lit(level.upper()))
    return df.where(F.upper(F.col("level")) == F.lit(level.upper()))


def filter_source(df: DataFrame, source: str | None) -> DataFrame:
    return df if source is None else df.where(F.col("source") == F.lit(source))


def search_msg(df: DataFrame, keyword: str, msg_col: str = "msg") -> DataFrame:
    """Case-insensitive regex search in the message (blank keyword keeps all rows)."""
    kw = keyword.strip()
    if not kw:
        return df
    return df.where(F.coalesce(F.col(msg_col).rlike(jre(kw, ignore_case=True)), F.lit(False)))


def redacted_flag(detected_col: str = "detected") -> F.Column:
    return F.size(F.col(detected_col)) > 0


def redacted_only(df: DataFrame, detected_col: str = "detected") -> DataFrame:
    """Rows with at least one redaction, raw text next to clean text."""
    cols = [c for c in ("time", "service", "source", "original_msg", "msg", "redacted_entities") if c in df.columns]
    # a plain filter would be pushed below the redaction, which then runs twice; one on a generated column is not
    hit = F.explode_outer(F.when(redacted_flag(detected_col), F.array(F.lit(True)))).alias("__lw_hit")
    return df.select(*cols, hit).where("__lw_hit").drop("__lw_hit")


def preview_columns(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in PREVIEW_COLUMNS if c in df.columns])


def merged_view(df: DataFrame, tie_cols: list[str] | None = None, rank_col: str | None = None) -> DataFrame:
    """All sources in one table ordered by the time *string*, then the tie columns.

    ``rank_col`` adds each row's place in that order instead of sorting the
    result. Every row is kept once, rows of one time and tie key (or of none)
    included; nulls come first.
    """
    order = ["time", *(tie_cols or [])]
    if rank_col is None:
        return df.orderBy(*order)
    return global_rank(df, order, rank_col=rank_col, ties=True).select(*order, *[c for c in df.columns if c not in order], rank_col)


def text_line(df: DataFrame) -> F.Column:
    """``time [level] [service] [source] - msg``."""
    src = F.col("source") if "source" in df.columns else F.lit("")
    return F.format_string("%s [%s] [%s] [%s] - %s", F.col("time"), F.col("level"), F.col("service"), src, F.col("msg"))


def total_measures(msg_col: str = "msg") -> list[Column]:
    """The aggregates behind a run's totals."""
    counted = F.coalesce(F.length(msg_col) > 0, F.lit(False))
    total = F.count_if(counted)
    fb = F.count_if(counted & (F.col("parse_method") == "fallback"))
    return [
        total.alias("total_lines"),
        F.count_if(counted & (F.size("detected") > 0)).alias("redacted_lines"),
        fb.alias("fallback_lines"),
        F.coalesce(F.bround(F.try_divide(fb * 100.0, total), 1), F.lit(0.0)).alias("fallback_pct"),
    ]


def run_totals(processed: DataFrame) -> DataFrame:
    """Lines parsed, lines with redactions, fallback lines and their share (1 decimal)."""
    return processed.agg(*total_measures())
