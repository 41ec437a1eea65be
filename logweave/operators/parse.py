"""Raw log lines → one log table (time, level, service, msg, parse_method).

Order per line: JSON object → six line formats (full-line match, first wins)
→ plain text. All of it is one projection of native expressions: the JSON
side uses the VARIANT type, the line formats are Java regexes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import jre, strip_text

# ── fixed values: public Grok base definitions and the six line formats ────
YEAR = r"(?>\d\d){1,2}"
MONTHNUM = r"(?:0?[1-9]|1[0-2])"
MONTHDAY = r"(?:(?:0[1-9])|(?:[12][0-9])|(?:3[01])|[1-9])"
HOUR = r"(?:2[0123]|[01]?[0-9])"
MINUTE = r"(?:[0-5][0-9])"
SECOND = r"(?:(?:[0-5]?[0-9]|60)(?:[:.,][0-9]+)?)"
ISO8601_TIMEZONE = rf"(?:Z|[+-]{HOUR}(?::?{MINUTE}))"
TIMESTAMP_ISO8601 = rf"{YEAR}-{MONTHNUM}-{MONTHDAY}[T ]{HOUR}:?{MINUTE}(?::?{SECOND})?{ISO8601_TIMEZONE}?"
LOGLEVEL = (
    r"(?:[Aa]lert|ALERT|[Tt]race|TRACE|[Dd]ebug|DEBUG|[Nn]otice|NOTICE|[Ii]nfo|INFO|"
    r"[Ww]arn?(?:ing)?|WARN?(?:ING)?|[Ee]rr?(?:or)?|ERR?(?:OR)?|[Cc]rit?(?:ical)?|CRIT?(?:ICAL)?|"
    r"[Ff]atal|FATAL|[Ss]evere|SEVERE|EMERG(?:ENCY)?|[Ee]merg(?:ency)?)"
)
DATA = r".*?"
GREEDYDATA = r".*"
NUMBER = r"(?:(?<![0-9.+-])(?>[+-]?(?:(?:[0-9]+(?:\.[0-9]+)?)|(?:\.[0-9]+))))"
INT = r"(?:[+-]?(?:[0-9]+))"
TIME = rf"(?!<[0-9]){HOUR}:{MINUTE}(?::{SECOND})(?![0-9])"
MONTH = (
    r"\b(?:[Jj]an(?:uary|uar)?|[Ff]eb(?:ruary|ruar)?|[Mm](?:a|ä)?r(?:ch|z)?|[Aa]pr(?:il)?|[Mm]a(?:y|i)?|"
    r"[Jj]un(?:e|i)?|[Jj]ul(?:y|i)?|[Aa]ug(?:ust)?|[Ss]ep(?:tember)?|[Oo](?:c|k)?t(?:ober)?|"
    r"[Nn]ov(?:ember)?|[Dd]e(?:c|z)(?:ember)?)\b"
)
HTTPDATE = rf"{MONTHDAY}/{MONTH}/{YEAR}:{TIME} {INT}"
SYSLOGTIMESTAMP = rf"{MONTH} +{MONTHDAY} {TIME}"
WORD = r"\b\w+\b"
HOSTNAME = r"\b(?:[0-9A-Za-z][0-9A-Za-z-]{0,62})(?:\.(?:[0-9A-Za-z][0-9A-Za-z-]{0,62}))*(?:\.?|\b)"
URIPATH = r"(?:/[A-Za-z0-9$.+!*'(){},~:;=@#%&_\-]*)+"
URIPARAM = r"\?[A-Za-z0-9$.+!*'|(){},~@#%&/=:;_?\-\[\]<>]*"
URIPATHPARAM = rf"{URIPATH}(?:{URIPARAM})?"


def _cap(p: str) -> str:
    return f"({p})"


# (name, full-line Java pattern, {field: group index}) in match order.
LINE_FORMATS: list[tuple[str, str, dict[str, int]]] = [
    (
        "standard",
        rf"{_cap(TIMESTAMP_ISO8601)}\s+\[?{_cap(LOGLEVEL)}\]?\s+\[{_cap(DATA)}\]\s+-\s+{_cap(GREEDYDATA)}",
        {"time": 1, "level": 2, "service": 3, "msg": 4},
    ),
    (
        "spring_boot",
        rf"{_cap(TIMESTAMP_ISO8601)}\s+{_cap(LOGLEVEL)}\s+{NUMBER}\s+---\s+\[{DATA}\]\s+{_cap(DATA)}\s*:\s*{_cap(GREEDYDATA)}",
        {"time": 1, "level": 2, "service": 3, "msg": 4},
    ),
    (
        "logback",
        rf"{_cap(TIME)}\s+\[{DATA}\]\s+{_cap(LOGLEVEL)}\s+{_cap(DATA)}\s+-\s+{_cap(GREEDYDATA)}",
        {"time": 1, "level": 2, "service": 3, "msg": 4},
    ),
    (
        "access_log",
        rf'\[{_cap(HTTPDATE)}\]\s+"{WORD} {_cap(URIPATHPARAM)} HTTP/{NUMBER}"\s+{_cap(NUMBER)}',
        {"time": 1, "msg": 2, "level": 3},
    ),
    (
        "syslog",
        rf"{_cap(SYSLOGTIMESTAMP)}\s+{HOSTNAME}\s+{_cap(DATA)}\[{NUMBER}\]:\s+{_cap(GREEDYDATA)}",
        {"time": 1, "service": 2, "msg": 3},
    ),
    (
        "level_msg",
        rf"{_cap(LOGLEVEL)}\s+{_cap(GREEDYDATA)}",
        {"level": 1, "msg": 2},
    ),
]
# ── end of fixed values ────────────────────────────────────────────────────


def _full(p: str) -> str:
    return jre(f"^(?:{p})$")


def normalise_level(c: Column) -> Column:
    """Upper-cased level if it is one of the known levels, else UNKNOWN."""
    up = F.upper(c)
    return F.when(up.isin(*C.LOG_LEVELS), up).otherwise(F.lit("UNKNOWN"))


def _record(time: Column, level: Column, service: Column, msg: Column, method: str, fmt: str | None = None) -> Column:
    fields = [time.alias("time"), level.alias("level"), service.alias("service"), msg.alias("msg"), F.lit(method).alias("parse_method")]
    if fmt is not None:
        fields.append(F.lit(fmt).alias("line_format"))
    return F.struct(*fields)


_JSON_ALIASES = C.JSON_ALIASES


def _vpath(key: str) -> str:
    return "$['" + key.replace("'", "\\'") + "']"


def _json_field(v: Column, key_list: list[str]) -> tuple[Column, Column, Column]:
    """(present, is_string, string value) of the first *present* key."""
    present = [F.try_variant_get(v, _vpath(k), "variant").isNotNull() for k in key_list]
    any_present = present[0]
    for p in present[1:]:
        any_present = any_present | p
    chosen = None
    for k, p in reversed(list(zip(key_list, present))):
        val = F.try_variant_get(v, _vpath(k), "variant")
        chosen = val if chosen is None else F.when(p, val).otherwise(chosen)
    is_str = F.coalesce(F.schema_of_variant(chosen) == F.lit("STRING"), F.lit(False))
    return any_present, is_str, F.try_variant_get(chosen, "$", "string")


def json_variant(line: Column) -> Column:
    """The line as VARIANT when it starts with '{' and is valid JSON, else NULL."""
    return F.when(line.startswith("{"), F.try_parse_json(line))


def _json_record(line: Column, with_format: bool = False, variant: Column | None = None) -> tuple[Column, Column]:
    """(ok, record) for a JSON object line; ok is False when validation fails."""
    v = json_variant(line) if variant is None else variant
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    ok = is_obj
    vals = {}
    for name in ("time", "service", "msg"):
        present, is_str, sval = _json_field(v, _JSON_ALIASES[name])
        ok = ok & (~present | is_str)
        vals[name] = (present, sval)
    lp, l_is_str, lval = _json_field(v, _JSON_ALIASES["level"])
    level = F.when(lp & l_is_str, normalise_level(lval)).otherwise(F.lit("UNKNOWN"))
    rec = _record(
        F.when(vals["time"][0], vals["time"][1]).otherwise(F.lit(C.DEFAULT_TIME)),
        level,
        F.when(vals["service"][0], vals["service"][1]).otherwise(F.lit(C.DEFAULT_SERVICE)),
        # no message key: keep the raw JSON text (deliberate; see README)
        F.when(vals["msg"][0], vals["msg"][1]).otherwise(line),
        "json",
        "json" if with_format else None,
    )
    return ok, rec


def parse_line(line: Column, with_format: bool = False, variant: Column | None = None) -> Column:
    """A struct (time, level, service, msg, parse_method[, line_format]) for a stripped line.

    ``variant`` may carry the line's VARIANT computed once (see :func:`parse_logs`).
    """
    ok, json_rec = _json_record(line, with_format, variant)
    expr = F.when(ok, json_rec)
    for name, pat, groups in LINE_FORMATS:
        jp = _full(pat)

        def g(field: str, default: Column, jp=jp, groups=groups) -> Column:
            if field not in groups:
                return default
            return F.regexp_extract(line, jp, groups[field])

        rec = _record(
            g("time", F.lit(C.DEFAULT_TIME)),
            normalise_level(g("level", F.lit("UNKNOWN"))),
            g("service", F.lit(C.DEFAULT_SERVICE)),
            g("msg", F.lit("")),
            "grok",
            name if with_format else None,
        )
        expr = expr.when(line.rlike(jp), rec)
    fb = _record(F.lit(C.DEFAULT_TIME), F.lit("UNKNOWN"), F.lit(C.DEFAULT_SERVICE), line, "fallback", "fallback" if with_format else None)
    return expr.otherwise(fb)


def skip_blank(df: DataFrame, line_col: str = "value") -> DataFrame:
    """Strip each line (Unicode whitespace) and drop empty ones."""
    return df.withColumn(line_col, strip_text(F.col(line_col))).where(F.length(F.col(line_col)) > 0)


def parse_logs(df: DataFrame, line_col: str = "value", keep: list[str] | None = None, with_format: bool = False) -> DataFrame:
    """Raw-line table → log table; ``keep`` columns (e.g. source) are carried along."""
    keep = keep if keep is not None else [c for c in df.columns if c != line_col]
    # the VARIANT is read by a dozen field lookups: compute it once per line
    stripped = skip_blank(df, line_col).withColumn("__lw_v", json_variant(F.col(line_col)))
    rec = parse_line(F.col(line_col), with_format=with_format, variant=F.col("__lw_v")).alias("__lw_rec")
    return stripped.select(*keep, rec).select(*keep, "__lw_rec.*")


def parse_method_share(parsed: DataFrame) -> DataFrame:
    """Fallback lines: count and percentage (1 decimal) of all parsed lines."""
    total = F.count(F.lit(1))
    fb = F.count_if(F.col("parse_method") == "fallback")
    return parsed.agg(
        total.alias("total_lines"),
        fb.alias("fallback_lines"),
        F.coalesce(F.bround(F.try_divide(fb * 100.0, total), 1), F.lit(0.0)).alias("fallback_pct"),
    )
