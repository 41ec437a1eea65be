"""Reading raw log files and writing the processed table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.views import text_line
from ..plans.rank import global_order


def _file_name() -> Column:
    """The file's name as it is on disk; the metadata column has it URL-escaped (``+`` is no escape there)."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


#: what ends a line beside the reader's own line feed and carriage return
_MORE_BREAKS = r"[\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def split_lines(value: Column) -> Column:
    """A physical line cut at the other line boundaries of Unicode text: VT, FF, FS to RS, NEL, U+2028, U+2029."""
    return F.when(value.rlike(_MORE_BREAKS), F.split(value, _MORE_BREAKS, -1)).otherwise(F.array(value))


def path_key(path: Column) -> Column:
    """A path without scheme and authority, so that ``file:/x``, ``file:///x`` and ``/x`` are one."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/]*)?", "")


def read_logs(
    spark: SparkSession,
    paths: str | list[str],
    labels: Mapping[str, str] | DataFrame | None = None,
    line_col: str = "value",
) -> DataFrame:
    """Text files → one row per line with a ``source`` label.

    The label is the file name without its last extension unless ``labels``
    says otherwise: a mapping, or a table (``file``, ``label``) for any number
    of files. A key with a ``/`` is a whole path (two folders may each hold an
    ``app.log``), another one a file name; the path goes first. Labels are
    joined, and Spark broadcasts them only below its size limit. Files that
    share a label are unioned.

    Undecodable bytes become U+FFFD. The reader ends lines at ``\\n``, ``\\r``
    and ``\\r\\n`` and spreads them over tasks; each is then cut at the other
    line boundaries, in order. (Where one of those is a file's last character,
    a blank line follows, which ``skip_blank`` drops.)
    """
    return labelled(spark.read.text(paths), labels, line_col)


def labelled(physical: DataFrame, labels: Mapping[str, str] | DataFrame | None, line_col: str = "value") -> DataFrame:
    """(line, file_name, source) of the text reader's rows, batch or stream; see :func:`read_logs`."""
    raw = physical.select(
        F.explode(split_lines(F.make_valid_utf8(F.col("value")))).alias(line_col),
        _file_name().alias("file_name"),
        path_key(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))).alias("file_path"),
    )
    default = F.regexp_replace(F.col("file_name"), r"\.[^.]*$", "")
    if labels is None:
        return raw.select(line_col, "file_name", default.alias("source"))
    if not isinstance(labels, DataFrame):
        rows = [F.struct(F.lit(k).alias("file"), F.lit(v).alias("label")) for k, v in labels.items()]
        if not rows:
            return raw.select(line_col, "file_name", default.alias("source"))
        labels = physical.sparkSession.range(1).select(F.inline(F.array(*rows)))
    known = labels.groupBy(path_key(F.col("file")).alias("__lw_file")).agg(F.max("label").alias("__lw_label"))
    by_path = known.withColumnsRenamed({"__lw_file": "file_path", "__lw_label": "__lw_by_path"})
    by_name = known.withColumnsRenamed({"__lw_file": "file_name", "__lw_label": "__lw_by_name"})
    out = raw.join(by_path, "file_path", "left").join(by_name, "file_name", "left")
    return out.select(line_col, "file_name", F.coalesce("__lw_by_path", "__lw_by_name", default).alias("source"))


_CSV = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"', "quote": '"'}


def _drop_raw(df: DataFrame, include_original: bool) -> DataFrame:
    drop = [c for c in df.columns if c.startswith("original_")] if not include_original else []
    # arrays do not fit CSV; the joined string carries the same information
    return df.drop(*drop)


def write_csv(df: DataFrame, path: str, include_original: bool = False, mode: str = "overwrite") -> None:
    """Full table with a header. Raw (unredacted) text is left out unless asked for."""
    out = _drop_raw(df, include_original)
    out = out.drop(*[f.name for f in out.schema.fields if f.dataType.typeName() in ("array", "map", "struct")])
    out.write.mode(mode).options(**_CSV).csv(path)


def write_ordered(df: DataFrame, path: str, order_cols: list[str], kind: str = "text", parts: int | None = None, include_original: bool = False) -> DataFrame:
    """One ordered set of files: the rows in the order of ``order_cols``, in part files whose names sort in that order.

    Rows are shuffled once, by ranges (equal ones kept apart by a row number,
    see :func:`~logweave.plans.rank.global_order`); a range's task writes the
    next part. ``kind`` is ``text``, ``csv`` or ``json``. Returns the manifest,
    also written to ``<path>_manifest``: ``part`` (place), ``file``, ``rows``
    and ``first_row`` (place of its first row in the table) of each part file.
    """
    spark = df.sparkSession
    dealt = global_order(df, order_cols, parts, ties=True)
    out = dealt.select(text_line(dealt).alias("value")) if kind == "text" else _drop_raw(dealt, include_original)
    if kind == "csv":
        out = out.drop(*[f.name for f in out.schema.fields if f.dataType.typeName() in ("array", "map", "struct")])
    options = _CSV if kind == "csv" else {}
    out.write.mode("overwrite").options(**options).format(kind).save(path)
    back = spark.read.schema(out.schema).options(**options, multiLine=kind == "csv").format(kind).load(path)
    files = back.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"))
    # a row per file, far below the rows they hold
    w = Window.orderBy("file")
    manifest = files.select(
        (F.row_number().over(w) - 1).alias("part"), "file", "rows",
        (F.sum("rows").over(w) - F.col("rows")).alias("first_row"),
    )
    manifest.write.mode("overwrite").json(f"{path}_manifest")
    return spark.read.schema("part int, file string, rows long, first_row long").json(f"{path}_manifest")


def write_text(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One ``time [level] [service] [source] - msg`` line per row."""
    df.select(text_line(df).alias("value")).write.mode(mode).text(path)


def write_json(df: DataFrame, path: str, include_original: bool = False, mode: str = "overwrite") -> None:
    """JSON Lines (splittable), non-ASCII kept as is."""
    _drop_raw(df, include_original).write.mode(mode).json(path)
