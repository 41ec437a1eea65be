"""The registered queries: each reads the given tables (or tables Spark derives
from them) and runs one operator of the library over all of it.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose columns
match the DuckDB oracle of the same name in ``oracles.py``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import config as C
from .operators import correlate, events, flow, latency, parse, redact, views
from .operators.process import process, write_processed
from .plans.rank import global_rank
from .session import configure, ensure_checkpoint_dir
from .sources import derived
from .sources import logs as logs_io
from .streaming.logs import stream_anomaly_windows

# Fixed settings of the registered queries. The driver's tables hold one
# event per ~4 minutes, so time settings are wide (see FIXTURES.md).
TOKEN_KEY = "fixture-key"
BUCKET_MINUTES = 60
ANOMALY_MINUTES, ANOMALY_SHARE, HOT_SHARE = 60, 0.5, 0.4
LANE_RULES, LANE_MODE = [C.LaneRule(pattern="purchase", lane_name="checkout")], "source_service"
CASCADE_SEC = 600
TRACKED_ID = "1700000000042"
SAMPLE_STEP = 5
MAX_POINTS = 3000
TS_FMT = "yyyy-MM-dd HH:mm:ss"


def _fmt(c: str) -> F.Column:
    return F.date_format(F.col(c), TS_FMT).alias(c)


def _logs(spark: SparkSession, sf: str) -> DataFrame:
    configure(spark)
    return derived.logs(spark, sf)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    configure(spark)
    return derived.table(spark, sf, "documents", ["doc_id", "source", "text"])


def _pii(spark: SparkSession, sf: str) -> DataFrame:
    configure(spark)
    return derived.pii(spark, sf)


def _only(*ents: str, kind: type = C.Replace, b64: bool = True, patterns: list[C.Pattern] | None = None) -> C.RedactionConfig:
    return C.RedactionConfig(TOKEN_KEY, C.built_in_rules(kind, ents), patterns or [], b64)


EMP = r"EMP\d{6}"
CUSTOM_EMP = C.Pattern("员工工号", EMP, C.Replace("<工号>"))


def _redact_query(source: Callable[[SparkSession, str], DataFrame], key: str, cfg: C.RedactionConfig, text: str = "text"):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        df = source(spark, sf)
        out = redact.redact(df, text, cfg)
        return out.select(key, F.col(text).alias("clean"), F.array_join("detected", ", ").alias("entities"))

    return q


def _parse_kind(kind: int | None):
    """Parse all events rendered in one line format (``None``: the mixed stream)."""

    def q(spark: SparkSession, sf: str) -> DataFrame:
        configure(spark)
        return parse.parse_logs(derived.raw(spark, sf, kind), "line", keep=["event_id", "kind"])

    return q


def _processed_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed and redacted lines whose messages are the documents' texts (with personal data)."""
    configure(spark)
    raw = derived.document_lines(spark, sf)
    return process(raw, C.RedactionConfig(), line_col="line", keep=["doc_id", "source"])


def q_process_all(spark, sf):
    return _processed_logs(spark, sf).select(
        "doc_id", "source", "time", "level", "service", "msg", "original_msg", "redacted_entities", "parse_method"
    )


def q_parse_method_share(spark, sf):
    return parse.parse_method_share(_parse_kind(None)(spark, sf))


def q_run_totals(spark, sf):
    return views.run_totals(_processed_logs(spark, sf))


def q_redaction_stats(spark, sf):
    out = redact.redact(_docs(spark, sf), "text", C.RedactionConfig(secret_key=TOKEN_KEY))
    return redact.redaction_stats(out, "source", "text")


def q_entity_counts(spark, sf):
    out = redact.redact(_docs(spark, sf), "text", C.RedactionConfig(secret_key=TOKEN_KEY))
    return redact.entity_counts(out, "source")


def q_redact_persons(spark, sf):
    configure(spark)
    notes = derived.order_notes(spark, sf)
    names = derived.customer_names(spark, sf)
    out = redact.redact_names(notes, names, ["o_orderkey"], "text", _only(C.PERSON))
    return out.select("o_orderkey", F.col("text").alias("clean"), F.array_join("detected", ", ").alias("entities"))


def q_redact_persons_long(spark, sf):
    configure(spark)
    notes = derived.long_name_notes(spark, sf)
    names = notes.select("name").distinct()
    out = redact.redact_names(notes, names, ["o_orderkey"], "text", _only(C.PERSON))
    return out.select("o_orderkey", F.col("text").alias("clean"), F.array_join("detected", ", ").alias("entities"))


def q_redact_custom_named(spark, sf):
    """A pattern with a named group, as Python writes it."""
    cfg = _only(b64=False, patterns=[C.Pattern("员工工号", r"(?P<emp_id>EMP\d{6})", C.Replace("<工号>"))])
    return _redact_query(_pii, "event_id", cfg)(spark, sf)


def q_assign_lane_any(spark, sf):
    """A rule that matches everything, also the empty message."""
    rules = [C.LaneRule("signup|", "signup or any")]
    return events.assign_lane(_logs(spark, sf), rules, "service").select("event_id", "lane")


def q_classify_custom(spark, sf):
    """A custom type that reuses a default name, and one whose keyword matches the empty string."""
    types = [C.EventType("error", "Purchase trouble", keywords=["purchase.*status 500", "purchase.*duration=9"]), C.EventType("seen", "Seen", keywords=["boom|"], levels=["DEBUG"])]
    return events.classify_event(_logs(spark, sf), types).select("event_id", "event_type", "event_display")


def q_search_unicode(spark, sf):
    """Unicode word characters around Chinese text."""
    lg = _logs(spark, sf).withColumn("msg", F.concat(F.lit("用户"), F.col("msg"), F.lit("登录")))
    return views.search_msg(lg, r"用户\w+ user 1\d .*登录").select("event_id", "msg")


def q_event_time_forms(spark, sf):
    """One-digit fields, slash dates and the compact hour-minute form."""
    lg = derived.logs(spark, sf)
    forms = ["yyyy-M-d H:mm:ss", "yyyy-MM-dd'T'HHmm", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm"]
    kind = (F.col("event_id") % len(forms)).cast("int")
    time = F.element_at(F.array(*[F.date_format("ts", f) for f in forms]), kind + 1)
    timed = events.with_event_time(lg.withColumn("time", time).drop("ts"))
    return timed.select("event_id", "time", _fmt("ts"))


def q_rate_correlation_large(spark, sf):
    """Counts of billions per bucket and a constant series: exact where doubles cancel out."""
    rb = correlate.rate_buckets(_logs(spark, sf), BUCKET_MINUTES)
    big = rb.select(
        F.concat(F.lit("big_"), F.col("source")).alias("source"), F.date_format("bucket", TS_FMT).alias("time"),
        F.lit("INFO").alias("level"), F.lit("s").alias("service"), F.lit("m").alias("msg"), "events",
    )
    times = big.select("time").distinct()
    flat = times.select(F.lit("flat").alias("source"), "time", F.lit("INFO").alias("level"), F.lit("s").alias("service"), F.lit("m").alias("msg"), F.lit(0).cast("long").alias("events"))
    weighted = big.unionByName(flat).withColumn("events", F.col("events") + 1_000_000_000)
    return correlate.rate_correlation(weighted, BUCKET_MINUTES, weight_col="events")


def _scratch(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/sink-{uuid.uuid4().hex}"


def q_sink_csv(spark, sf):
    """The log table written as CSV and read back as text fields."""
    path = _scratch(spark)
    lg = _logs(spark, sf).drop("ts").withColumn("msg", F.concat(F.lit('  "'), F.col("msg"), F.lit('", x  ')))
    logs_io.write_csv(lg, path)
    back = spark.read.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return back.withColumn("event_id", F.col("event_id").cast("long"))


def q_sink_json(spark, sf):
    path = _scratch(spark)
    lg = _logs(spark, sf).drop("ts").withColumn("original_msg", F.lit("raw"))
    logs_io.write_json(lg, path)
    return spark.read.json(path).select("event_id", "source", "time", "level", "service", "msg")


def q_sink_text(spark, sf):
    """Text lines written by the sink and read again by ``read_logs``."""
    path = _scratch(spark)
    logs_io.write_text(_logs(spark, sf), path)
    return logs_io.read_logs(spark, path).select(F.col("value").alias("line"))


def q_read_logs_labelled(spark, sf):
    """One folder of files per source, merged; a table of paths gives each file its folder as label."""
    path, lines = _scratch(spark), derived.raw(spark, sf)
    for k in range(4):  # one write per source, so that file names differ
        lines.where(F.col("source") == f"src{k}").select("line").write.text(f"{path}/src{k}")
    files = spark.read.format("binaryFile").load(f"{path}/*").select(F.col("path").alias("file"))
    folder = F.element_at(F.split("file", "/"), -2)
    labels = files.withColumn("label", F.concat(folder, F.lit(" (label)")))
    return logs_io.read_logs(spark, f"{path}/*", labels).select(F.col("value").alias("line"), "source")


#: every line boundary, and one byte that is no UTF-8 in the last kind
LINE_BREAKS = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]


def q_read_logs_breaks(spark, sf):
    """Files whose lines end in every boundary Unicode text knows, some with undecodable bytes."""
    path, lg = _scratch(spark), _logs(spark, sf)
    cut = F.element_at(F.array(*map(F.lit, LINE_BREAKS)), (F.col("event_id") % len(LINE_BREAKS) + 1).cast("int"))
    rest = F.when(F.col("event_id") % 7 == 0, F.unhex(F.lit("61FF62"))).otherwise(F.encode(F.col("source"), "UTF-8"))
    lines = F.concat(F.encode(F.concat("service", cut), "UTF-8"), rest).cast("string")
    lg.select(lines.alias("value")).write.text(path)
    return logs_io.read_logs(spark, path).select(F.col("value").alias("line"))


def q_skip_blank(spark, sf):
    """Blank lines, of Unicode white space too, among others with white space around them."""
    path, lg = _scratch(spark), _logs(spark, sf)
    blanks = ["", " ", "\t \t", "\u3000", "\u00a0\u2003"]
    pad = F.element_at(F.array(*map(F.lit, blanks)), (F.col("event_id") % len(blanks) + 1).cast("int"))
    line = F.when(F.col("event_id") % 3 == 0, pad).otherwise(F.concat(pad, "msg", pad))
    lg.select(line.alias("value")).write.text(path)
    return parse.skip_blank(logs_io.read_logs(spark, path)).select(F.col("value").alias("line"))


def q_export_ordered(spark, sf):
    """One ordered set of text files, read back part by part in the manifest's order."""
    path, lg = _scratch(spark), _logs(spark, sf)
    manifest = logs_io.write_ordered(lg, path, ["time", "event_id"])
    parts = spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_name").alias("file"))
    lines = parts.select("file", F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("at", "line"))
    return lines.join(manifest, "file").select((F.col("first_row") + F.col("at")).alias("place"), "line")


def q_export_totals(spark, sf):
    """Export and statistics from one job."""
    path = _scratch(spark)
    out = write_processed(_processed_logs(spark, sf), lambda df: logs_io.write_json(df, path))
    return out.select("total_lines", "redacted_lines", "fallback_lines", "fallback_pct", F.map_values("entity_lines")[1].alias("phone_lines"))


def q_redact_custom_many(spark, sf):
    """Fifty patterns of the user's own, ten of which occur."""
    hits = [C.Pattern(f"ends in {d}", rf"EMP\d{{5}}{d}", C.Replace(f"<E{d}>")) for d in range(10)]
    others = [C.Pattern(f"badge {i}", rf"BADGE{i:03d}-\w+") for i in range(40)]
    return _redact_query(_pii, "event_id", _only(b64=False, patterns=[*others, *hits]))(spark, sf)


def q_shared_ids_top(spark, sf):
    """The report's first 300 identifiers, each with its place."""
    top = correlate.shared_ids(_logs(spark, sf), top=300, bloom_bits=1 << 20)
    place = F.row_number().over(Window.orderBy(F.col("n_sources").desc(), F.col("n_occurrences").desc(), "id"))  # of 300 rows
    return top.select("id", "n_sources", "n_occurrences", place.alias("place"))


def q_downsample_auto(spark, sf):
    """The chart's own step, from the number of rows."""
    timed = events.with_event_time(_logs(spark, sf)).select("event_id", "ts", "source")
    return events.downsample(timed, ["ts", "event_id"], MAX_POINTS).select("event_id", _fmt("ts"), "source")


def q_event_density_sampled(spark, sf):
    d = events.sampled_density(_classified(spark, sf), ["ts", "event_id"], MAX_POINTS, BUCKET_MINUTES, HOT_SHARE)
    return d.select(_fmt("bucket"), "events", "errors", "hot")


def q_latency_sketches(spark, sf):
    """Percentiles of the morning hours from stored sketches; each must lie within 1 % of its rank among the samples."""
    path, points = _scratch(spark), latency.latency_points(_logs(spark, sf))
    latency.latency_sketches(points).write.parquet(path)
    morning = lambda c: F.hour(c) < 12
    est = latency.sketch_summary(spark.read.parquet(path).where(morning(F.col("bucket"))), digits=None)
    ranked = points.where(morning(F.col("ts"))).join(est, "service")
    ok = []
    for name, rank in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        below = F.count_if(F.col("latency_ms") < F.col(f"{name}_ms")) / F.count("*")
        to = F.count_if(F.col("latency_ms") <= F.col(f"{name}_ms")) / F.count("*")
        ok.append(((below <= rank + 0.01) & (to >= rank - 0.01)).alias(f"{name}_ok"))
    return ranked.groupBy("service").agg(F.max("samples").alias("samples"), F.max("max_ms").alias("max_ms"), *ok)


def q_anomaly_windows_stream(spark, sf):
    """The log table as a stream of files in no order of time; a last line far ahead closes all windows."""
    path, lg = _scratch(spark), _logs(spark, sf).select("time", "level", "service", "msg")
    lg.repartition(6).write.json(f"{path}/in")
    last = lg.agg(F.date_format(F.max(F.to_timestamp("time")) + F.expr("interval 20000 days"), TS_FMT).alias("time"))
    last.select("time", *[F.lit("INFO").alias(c) for c in ("level", "service", "msg")]).coalesce(1).write.mode("append").json(f"{path}/in")
    lines = spark.readStream.schema(lg.schema).option("maxFilesPerTrigger", 2).json(f"{path}/in")
    out = stream_anomaly_windows(lines, ANOMALY_MINUTES, ANOMALY_SHARE, watermark_minutes=60 * 24 * 10000)
    run = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    done = spark.read.schema(out.schema).parquet(f"{path}/out")
    return done.select(_fmt("start"), _fmt("end"), "label", "buckets")


def q_latency_by_p95(spark, sf):
    """Services from the smallest to the largest P95."""
    s = latency.latency_summary(latency.extract_latency(_logs(spark, sf)))
    return global_rank(s.select("p95_ms", "service"), ["p95_ms", "service"], rank_col="place")


def q_cascades_by_count(spark, sf):
    c = correlate.error_cascades(_logs(spark, sf), CASCADE_SEC).select((-F.col("cascades")).alias("less"), "source_a", "source_b")
    return global_rank(c, ["less", "source_a", "source_b"], rank_col="place").drop("less")


def q_shared_ids_custom(spark, sf):
    """An identifier pattern of the user's own beside the default ones."""
    return correlate.shared_ids(_logs(spark, sf), [*C.DEFAULT_ID_PATTERNS, r"\buser \d{3,}\b"]).select("id", "sources", "n_sources", "n_occurrences")


def q_redact_persons_external(spark, sf):
    """Names found by the caller (any array column), redacted after the JSON-name layer."""
    notes = derived.order_notes(spark, sf).withColumn("mine", F.regexp_extract_all("text", F.lit(r"#\d+"), 0))
    out = redact.redact(notes, "text", _only(C.PERSON), persons_col="mine")
    return out.select("o_orderkey", F.col("text").alias("clean"), F.array_join("detected", ", ").alias("entities"))


def q_source_summary(spark, sf):
    out = redact.redact(_docs(spark, sf), "text", C.RedactionConfig(secret_key=TOKEN_KEY))
    return redact.source_summary(out, "source", order_col="doc_id", text_col="text")


def q_lane_axis(spark, sf):
    return events.lane_axis(_classified(spark, sf))


def q_service_axis(spark, sf):
    return latency.service_axis(latency.latency_points(_logs(spark, sf)))


def q_parse_json_edge(spark, sf):
    configure(spark)
    lines = derived.json_lines_from_logs(derived.logs(spark, sf))
    return parse.parse_logs(lines, "line", keep=["event_id", "kind"])


def q_redacted_flag(spark, sf):
    out = redact.redact(_docs(spark, sf), "text", C.RedactionConfig(secret_key=TOKEN_KEY))
    return out.select("doc_id", views.redacted_flag().alias("redacted"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    configure(spark)
    return derived.table(spark, sf, "pages", ["page_id", "html"]).withColumnRenamed("html", "text")


def q_filter_level(spark, sf):
    """On the stored log table, whose levels are normalised: the predicate reaches the scan."""
    path = _scratch(spark)
    _logs(spark, sf).drop("ts").write.parquet(path)
    stored = views.filter_level(spark.read.parquet(path), "error", normalised=True)
    return stored.select("event_id", "source", "time", "level", "service", "msg")


def q_filter_source(spark, sf):
    return views.filter_source(_logs(spark, sf), "src2").select("event_id", "source", "time", "level", "msg")


def q_search_msg(spark, sf):
    return views.search_msg(_logs(spark, sf), "SIGNUP user 1[0-9] ").select("event_id", "source", "msg")


def q_redacted_only(spark, sf):
    df = _docs(spark, sf)
    out = redact.redact_text(df, "text", C.RedactionConfig(secret_key=TOKEN_KEY))
    out = out.withColumn("original_msg", F.col("original_text")).withColumn("msg", F.col("text"))
    return views.redacted_only(out).select(
        F.col("source"), "original_msg", "msg", "redacted_entities"
    )


def q_merged_view(spark, sf):
    lg = _logs(spark, sf)
    ranked = views.merged_view(lg, ["event_id"], rank_col="place")
    return ranked.select("event_id", "place", *[c for c in views.preview_columns(lg).columns])


def q_export_text_line(spark, sf):
    lg = _logs(spark, sf)
    return lg.select("event_id", views.text_line(lg).alias("line"))


def _classified(spark, sf):
    return events.classified_timeline(_logs(spark, sf), lane_rules=LANE_RULES, lane_mode=LANE_MODE)


def q_classify_event(spark, sf):
    lg = _logs(spark, sf)
    return events.classify_event(lg).select("event_id", "event_type", "event_display")


def q_assign_lane(spark, sf):
    lg = _logs(spark, sf)
    return events.assign_lane(lg, LANE_RULES, LANE_MODE).select("event_id", "lane")


def q_timeline_points(spark, sf):
    pts = events.timeline_points(_logs(spark, sf), ("event_id",), lane_rules=LANE_RULES, lane_mode=LANE_MODE)
    return pts.select("event_id", _fmt("ts"), "lane", "event_type", "event_display", "level", "msg")


def q_event_density(spark, sf):
    d = events.event_density(_classified(spark, sf), BUCKET_MINUTES, HOT_SHARE)
    return d.select(_fmt("bucket"), "events", "errors", "hot")


def q_anomaly_buckets(spark, sf):
    b = events.anomaly_buckets(_classified(spark, sf), ANOMALY_MINUTES, ANOMALY_SHARE)
    return b.select(_fmt("bucket"), "total", "errors", F.bround("rate", 6).alias("rate"))


def q_anomaly_windows(spark, sf):
    w = events.anomaly_windows(_classified(spark, sf), ANOMALY_MINUTES, ANOMALY_SHARE)
    return w.select(_fmt("start"), _fmt("end"), "label", "buckets")


def q_downsample(spark, sf):
    lg = _logs(spark, sf)
    timed = events.with_event_time(lg).select("event_id", "ts", "source")
    out = events.downsample_every(timed, SAMPLE_STEP, ["ts", "event_id"])
    return out.select("event_id", _fmt("ts"), "source")


def q_extract_latency(spark, sf):
    s = latency.extract_latency(_logs(spark, sf), snippet=100)
    return s.select("event_id", "service", "latency_ms", "time", "msg", "msg_snippet")


def q_latency_points(spark, sf):
    p = latency.latency_points(_logs(spark, sf))
    return p.select("event_id", _fmt("ts"), "service", "latency_ms", "msg")


def q_latency_summary(spark, sf):
    return latency.latency_summary(latency.extract_latency(_logs(spark, sf)))


def q_rate_buckets(spark, sf):
    r = correlate.rate_buckets(_logs(spark, sf), BUCKET_MINUTES)
    return r.select("source", _fmt("bucket"), "events")


def q_rate_correlation(spark, sf):
    return correlate.rate_correlation(_logs(spark, sf), BUCKET_MINUTES)


def q_error_cascades(spark, sf):
    return correlate.error_cascades(_logs(spark, sf), CASCADE_SEC).drop("trigger_pct")


def q_cascade_matrix(spark, sf):
    return correlate.cascade_matrix(correlate.error_cascades(_logs(spark, sf), CASCADE_SEC))


def q_shared_ids(spark, sf):
    return correlate.shared_ids(_logs(spark, sf)).select(
        "id", "sources", "n_sources", "n_occurrences", "first_seen", "last_seen", "span_s"
    )


def q_track_id(spark, sf):
    t = correlate.track_id(_logs(spark, sf), TRACKED_ID, snippet=100)
    return t.select("source", _fmt("ts"), "msg", "snippet")


def q_service_flow(spark, sf):
    return flow.service_flow(_logs(spark, sf))


def q_flow_nodes(spark, sf):
    return flow.flow_nodes(flow.service_flow(_logs(spark, sf)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    # redaction on free text (documents) — whole texts
    q["redact_email"] = _redact_query(_docs, "doc_id", _only(C.EMAIL))
    q["redact_ip"] = _redact_query(_docs, "doc_id", _only(C.IP))
    q["redact_card"] = _redact_query(_docs, "doc_id", _only(C.CARD))
    q["redact_all"] = _redact_query(_docs, "doc_id", C.RedactionConfig(secret_key=TOKEN_KEY))
    q["redact_mask"] = _redact_query(_docs, "doc_id", _only(*C.ALL_ENTITIES, kind=C.Mask))
    q["redact_redact"] = _redact_query(_docs, "doc_id", _only(*C.ALL_ENTITIES, kind=C.Remove))
    q["redact_token"] = _redact_query(_docs, "doc_id", _only(*C.ALL_ENTITIES, kind=C.Token))
    q["redact_pages"] = _redact_query(_pages, "page_id", C.RedactionConfig(secret_key=TOKEN_KEY))
    # one entity kind at a time on the derived PII texts
    q["redact_phone"] = _redact_query(_pii, "event_id", _only(C.PHONE, b64=False))
    q["redact_cn_id"] = _redact_query(_pii, "event_id", _only(C.CN_ID, b64=False))
    q["redact_org_code"] = _redact_query(_pii, "event_id", _only(C.ORG_CODE, b64=False))
    q["redact_json_name"] = _redact_query(_pii, "event_id", _only(C.PERSON, b64=False))
    q["redact_base64"] = _redact_query(_pii, "event_id", _only())
    q["redact_custom"] = _redact_query(_pii, "event_id", _only(b64=False, patterns=[CUSTOM_EMP]))
    q["redact_pii_all"] = _redact_query(_pii, "event_id", _only(*C.ALL_ENTITIES, patterns=[CUSTOM_EMP]))
    masked = _only(*C.ALL_ENTITIES, kind=C.Mask, patterns=[C.Pattern("员工工号", EMP, C.Mask(3, 4))])
    q["redact_pii_mask"] = _redact_query(_pii, "event_id", masked)
    tokens = _only(*C.ALL_ENTITIES, kind=C.Token, patterns=[C.Pattern("员工工号", EMP, C.Token())])
    q["redact_pii_token"] = _redact_query(_pii, "event_id", tokens)
    q["redact_persons"] = q_redact_persons
    q["redact_persons_external"] = q_redact_persons_external
    q["shared_ids_custom"] = q_shared_ids_custom
    q["sink_csv"] = q_sink_csv
    q["sink_json"] = q_sink_json
    q["sink_text"] = q_sink_text
    q["read_logs_labelled"] = q_read_logs_labelled
    q["read_logs_breaks"] = q_read_logs_breaks
    q["skip_blank"] = q_skip_blank
    q["export_ordered"] = q_export_ordered
    q["export_totals"] = q_export_totals
    q["redact_custom_many"] = q_redact_custom_many
    q["shared_ids_top"] = q_shared_ids_top
    q["downsample_auto"] = q_downsample_auto
    q["event_density_sampled"] = q_event_density_sampled
    q["latency_sketches"] = q_latency_sketches
    q["anomaly_windows_stream"] = q_anomaly_windows_stream
    q["latency_by_p95"] = q_latency_by_p95
    q["cascades_by_count"] = q_cascades_by_count
    q["redact_persons_long"] = q_redact_persons_long
    q["redact_custom_named"] = q_redact_custom_named
    q["assign_lane_any"] = q_assign_lane_any
    q["classify_custom"] = q_classify_custom
    q["search_unicode"] = q_search_unicode
    q["event_time_forms"] = q_event_time_forms
    q["rate_correlation_large"] = q_rate_correlation_large
    q["redaction_stats"] = q_redaction_stats
    q["source_summary"] = q_source_summary
    q["entity_counts"] = q_entity_counts
    # parsing
    q["parse_all"] = _parse_kind(None)
    for kind, name in enumerate(["standard", "spring_boot", "logback", "access_log", "syslog", "json", "level_msg", "fallback"]):
        q[f"parse_{name}"] = _parse_kind(kind)
    q["parse_json_edge"] = q_parse_json_edge
    q["parse_method_share"] = q_parse_method_share
    q["process_all"] = q_process_all
    q["run_totals"] = q_run_totals
    # views
    q["filter_level"] = q_filter_level
    q["filter_source"] = q_filter_source
    q["search_msg"] = q_search_msg
    q["redacted_only"] = q_redacted_only
    q["redacted_flag"] = q_redacted_flag
    q["merged_view"] = q_merged_view
    q["export_text_line"] = q_export_text_line
    # timeline
    q["classify_event"] = q_classify_event
    q["assign_lane"] = q_assign_lane
    q["timeline_points"] = q_timeline_points
    q["event_density"] = q_event_density
    q["anomaly_buckets"] = q_anomaly_buckets
    q["anomaly_windows"] = q_anomaly_windows
    q["downsample"] = q_downsample
    q["lane_axis"] = q_lane_axis
    # latency
    q["extract_latency"] = q_extract_latency
    q["latency_points"] = q_latency_points
    q["latency_summary"] = q_latency_summary
    q["service_axis"] = q_service_axis
    # correlation and flow
    q["rate_buckets"] = q_rate_buckets
    q["rate_correlation"] = q_rate_correlation
    q["error_cascades"] = q_error_cascades
    q["cascade_matrix"] = q_cascade_matrix
    q["shared_ids"] = q_shared_ids
    q["track_id"] = q_track_id
    q["service_flow"] = q_service_flow
    q["flow_nodes"] = q_flow_nodes
    return q
