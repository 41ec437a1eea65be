"""Parse + redact: the processed log table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .. import config as C
from .parse import parse_logs
from .redact import redact
from .views import total_measures


def process(
    raw: DataFrame,
    cfg: C.RedactionConfig | None = None,
    line_col: str = "value",
    keep: list[str] | None = None,
    persons_col: str | None = None,
) -> DataFrame:
    """Raw lines → (kept columns…, time, level, service, msg, original_msg, detected,
    redacted_entities, parse_method). ``msg`` is the redacted text."""
    parsed = parse_logs(raw, line_col, keep=keep)
    parsed = parsed.withColumn("original_msg", F.col("msg"))
    out = redact(parsed, "msg", cfg, persons_col=persons_col)
    out = out.withColumn("redacted_entities", F.array_join("detected", ", "))
    front = [c for c in out.columns if c not in (
        "time", "level", "service", "msg", "original_msg", "detected", "redacted_entities", "parse_method")]
    return out.select(*front, "time", "level", "service", "msg", "original_msg", "detected", "redacted_entities", "parse_method")


def write_processed(processed: DataFrame, write: Callable[[DataFrame], None], entities: list[str] | None = None) -> DataFrame:
    """Write the processed table and return the run's totals from the same job.

    ``write`` is any sink (``lambda df: write_json(df, path)``). The totals of
    :func:`~logweave.operators.views.run_totals` and the lines per entity
    (``entities``, default the built-in ones) are observed on the rows as they pass to
    the sink, so the statistics cost no second parse and redaction. One row:
    the totals and a map ``entity_lines``.
    """
    entities = entities if entities is not None else C.ALL_ENTITIES
    seen = Observation()
    lines = [F.count_if(F.array_contains("detected", e)).alias(f"e{i}") for i, e in enumerate(entities)]
    totals = total_measures()
    write(processed.observe(seen, *totals, *lines))
    got = seen.get
    names = ["total_lines", "redacted_lines", "fallback_lines", "fallback_pct"]
    counts = [x for i, e in enumerate(entities) for x in (F.lit(e), F.lit(int(got[f"e{i}"])).cast("long"))]
    kept = [F.lit(float(got[n]) if n.endswith("pct") else int(got[n])).cast("double" if n.endswith("pct") else "long").alias(n) for n in names]
    return processed.sparkSession.range(1).select(*kept, F.create_map(*counts).alias("entity_lines"))
