"""Parsing cases of the reference's tests and README, sources, sinks, streaming, entry."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from logweave import config as C
from logweave.operators.parse import parse_logs, parse_method_share
from logweave.operators.process import process
from logweave.sources.logs import read_logs, write_csv, write_json, write_text


def parse(spark, lines):
    df = spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "i int, value string")
    return {r["i"]: r.asDict() for r in parse_logs(df, with_format=True).collect()}


def test_reference_parser_cases(spark):
    out = parse(spark, [
        '{"time": "2024-01-01 12:00:00", "service": "auth", "msg": "user login"}',
        '{"@timestamp": "2024-01-01T12:00:00Z", "app": "payment", "message": "charge ok"}',
        "2024-01-01T12:00:00 [INFO] [order-service] - Order placed successfully",
        "something went wrong",
        "   ",
        "", "  ", '{"msg": "hello"}',
    ])
    assert (out[0]["service"], out[0]["msg"], out[0]["parse_method"]) == ("auth", "user login", "json")
    assert (out[1]["service"], out[1]["msg"], out[1]["time"]) == ("payment", "charge ok", "2024-01-01T12:00:00Z")
    assert (out[2]["service"], out[2]["level"], out[2]["msg"]) == ("order-service", "INFO", "Order placed successfully")
    assert out[3]["msg"] == "something went wrong" and out[3]["parse_method"] == "fallback"
    assert set(out) == {0, 1, 2, 3, 7} and out[7]["msg"] == "hello"


def test_readme_formats(spark):
    out = parse(spark, [
        '{"time":"2024-01-01","service":"auth","msg":"login"}',
        "2024-01-01T12:00:00 [INFO] [service] - message",
        "2024-01-01 12:00:00  INFO 123 --- [main] com.app : message",
        "12:00:00.000 [main] INFO  service - message",
        "Jan  1 12:00:00 host service[123]: message",
        '[01/Jan/2024:12:00:00 +0000] "GET /path HTTP/1.1" 200',
        "anything else",
        "ERROR boom", "x ERROR boom",
        '1.2.3.4 - - [01/Jan/2024:12:00:00 +0000] "GET /path HTTP/1.1" 200',
    ])
    fmts = [out[i]["line_format"] for i in range(10)]
    assert fmts == ["json", "standard", "spring_boot", "logback", "syslog", "access_log", "fallback", "level_msg", "fallback", "fallback"]
    assert (out[5]["msg"], out[5]["level"], out[5]["service"]) == ("/path", "UNKNOWN", "unknown")
    assert (out[2]["service"], out[3]["time"], out[4]["service"]) == ("com.app", "12:00:00.000", "service")


def test_json_strictness(spark):
    out = parse(spark, [
        '{"time":17,"msg":"x"}', '{"msg":null,"message":"y"}', '{"level":null,"severity":"ERROR","msg":"z"}',
        '{"msg":"a","msg":"b"}', "{bad", '{"x":1}', '{"level":"warning","msg":"w"}', '{"level":5,"msg":"w"}',
        '{"msg":"n","service":{"a":1}}',
    ])
    assert [out[i]["parse_method"] for i in range(9)] == ["fallback", "fallback", "json", "json", "fallback", "json", "json", "json", "fallback"]
    assert out[2]["level"] == "UNKNOWN" and out[3]["msg"] == "b" and out[5]["msg"] == '{"x":1}'
    assert out[6]["level"] == "WARNING" and out[7]["level"] == "UNKNOWN"


def test_read_logs_labels_and_sinks(spark):
    d = tempfile.mkdtemp(prefix="lw-io-")
    with open(os.path.join(d, "app.log"), "wb") as f:
        f.write("2024-01-01 12:00:00 [ERROR] [pay] - card 4111111111111111 declined\n\n".encode())
        f.write(b"note \xff bad byte\n")
    with open(os.path.join(d, "web.server.txt"), "w") as f:
        f.write('{"time": "2024-01-01 12:00:01", "service": "web", "msg": "mail a@b.cc"}\n')
    raw = read_logs(spark, d, labels={"app.log": "payments"})
    assert {r["source"] for r in raw.collect()} == {"payments", "web.server"}
    assert any("�" in r["value"] for r in raw.collect())
    out = process(raw, C.RedactionConfig(), keep=["source"])
    rows = {r["source"]: r for r in out.collect() if r["parse_method"] != "fallback"}
    assert rows["payments"]["msg"] == "card <卡号>declined" and rows["web.server"]["redacted_entities"] == C.EMAIL
    base = tempfile.mkdtemp(prefix="lw-out-")
    write_csv(out, f"{base}/csv")
    write_text(out, f"{base}/txt")
    write_json(out, f"{base}/json")
    back = spark.read.option("header", True).csv(f"{base}/csv")
    assert "original_msg" not in back.columns and back.count() == 3
    lines = [r["value"] for r in spark.read.text(f"{base}/txt").collect()]
    assert "2024-01-01 12:00:00 [ERROR] [pay] [payments] - card <卡号>declined" in lines
    js = [json.loads(l) for p in os.listdir(f"{base}/json") if p.endswith(".json") for l in open(f"{base}/json/{p}", encoding="utf-8")]
    assert any(j["msg"] == "mail <邮箱>" for j in js)
    share = parse_method_share(out).first()
    assert (share["total_lines"], share["fallback_lines"], share["fallback_pct"]) == (3, 1, 33.3)


def test_streaming_process(spark):
    from logweave.streaming.logs import process_stream, read_log_stream

    d = tempfile.mkdtemp(prefix="lw-stream-in-")
    with open(os.path.join(d, "svc.log"), "w") as f:
        f.write("2024-01-01 12:00:00 [INFO] [svc] - call 13812345678\nERROR disk full\n")
    q = process_stream(read_log_stream(spark, d)).writeStream.format("memory").queryName("lw_stream_out").start()
    q.processAllAvailable()
    rows = spark.sql("select * from lw_stream_out").collect()
    q.stop()
    assert sorted(r["msg"] for r in rows) == ["call <手机>", "disk full"]
    assert {r["source"] for r in rows} == {"svc"} and "original_msg" not in rows[0].asDict()


def test_entry_and_registry(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0 and set(df.columns) == {"source", "total_lines", "redacted_lines"}
    qs, os_ = E.queries(), E.oracle_sql()
    assert set(os_) <= set(qs) and len(qs) >= 50
    # every registered query builds a plan on the smallest tables
    for name, fn in qs.items():
        fn(spark, "/root/testdata/sf0.001").schema  # noqa: B018
    assert F is not None


def test_streaming_file_sink_restarts(spark):
    from logweave.streaming.logs import start_processing

    src = tempfile.mkdtemp(prefix="lw-sin-")
    out = tempfile.mkdtemp(prefix="lw-sout-")
    ck = tempfile.mkdtemp(prefix="lw-sck-")
    with open(os.path.join(src, "a.log"), "w") as f:
        f.write("2024-01-01 12:00:00 [INFO] [svc] - mail x@y.zz\n")
    q = start_processing(spark, src, out, ck, trigger_available_now=True)
    q.awaitTermination(120)
    with open(os.path.join(src, "b.log"), "w") as f:
        f.write("ERROR card 4111111111111111\n")
    q = start_processing(spark, src, out, ck, trigger_available_now=True)  # resumes from the checkpoint
    q.awaitTermination(120)
    rows = spark.read.parquet(out).collect()
    assert sorted((r["source"], r["msg"]) for r in rows) == [("a", "mail <邮箱>"), ("b", "card <卡号>")]


def test_sinks_keep_raw_text_only_on_request(spark):
    df = spark.createDataFrame([("2024-01-01 12:00:00 [INFO] [s] - tel 13812345678", "a")], "value string, source string")
    out = process(df, C.RedactionConfig(), keep=["source"])
    base = tempfile.mkdtemp(prefix="lw-raw-")
    write_json(out, f"{base}/with", include_original=True)
    write_json(out, f"{base}/without")
    w = spark.read.json(f"{base}/with").first()
    assert w["original_msg"] == "tel 13812345678" and w["msg"] == "tel <手机>"
    assert "original_msg" not in spark.read.json(f"{base}/without").columns


def test_stream_event_density_matches_batch(spark):
    from logweave.operators import events
    from logweave.streaming.logs import process_stream, read_log_stream, stream_event_density

    d = tempfile.mkdtemp(prefix="lw-sd-")
    lines = [f"2024-01-01 12:{m:02d}:00 [{'ERROR' if m % 3 == 0 else 'INFO'}] [svc] - call {m}" for m in range(0, 20)]
    with open(os.path.join(d, "svc.log"), "w") as f:
        f.write("\n".join(lines) + "\n")
    q = (stream_event_density(process_stream(read_log_stream(spark, d)), bucket_minutes=5, watermark_minutes=10)
         .writeStream.outputMode("update").format("memory").queryName("lw_density").start())
    q.processAllAvailable()
    got = {r["bucket"]: (r["events"], r["errors"]) for r in spark.sql("select * from lw_density").collect()}
    q.stop()
    batch = process(spark.createDataFrame([(l,) for l in lines], "value string"), C.RedactionConfig(), keep=[])
    want = {r["bucket"]: (r["events"], r["errors"]) for r in events.event_density(events.classified_timeline(batch), 5).collect()}
    assert got == want and len(got) == 4


def test_level_filter_reaches_the_scan(spark):
    from logweave.operators.views import filter_level

    df = spark.createDataFrame([("2024-01-01 12:00:00 [ERROR] [s] - boom",), ("INFO fine",)], "value string")
    base = tempfile.mkdtemp(prefix="lw-push-")
    process(df, C.RedactionConfig(), keep=[]).drop("detected").write.parquet(f"{base}/t")
    stored = spark.read.parquet(f"{base}/t")
    q = filter_level(stored, "error", normalised=True)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(level), EqualTo(level,ERROR)]" in plan
    assert [r["msg"] for r in q.collect()] == ["boom"]
    assert filter_level(stored, "error").count() == 1


def test_names_with_escapes_and_csv_round_trip(spark, tmp_path):
    from logweave.sources.logs import read_logs, write_csv

    (tmp_path / "my app+1.log").write_text("one\n", encoding="utf-8")
    (tmp_path / "应用 日志.log").write_text("two\n", encoding="utf-8")
    got = {r["file_name"]: r["source"] for r in read_logs(spark, str(tmp_path), labels={"应用 日志.log": "app"}).collect()}
    assert got == {"my app+1.log": "my app+1", "应用 日志.log": "app"}
    rows = [('  pad "q", x  ', 1), ("plain", 2), ('\\"', 3)]
    write_csv(spark.createDataFrame(rows, "msg string, n int"), str(tmp_path / "out"))
    import csv
    import glob

    back = []
    for p in glob.glob(str(tmp_path / "out" / "*.csv")):
        with open(p, newline="", encoding="utf-8") as f:
            back += [(r["msg"], int(r["n"])) for r in csv.DictReader(f)]
    assert sorted(back) == sorted(rows)


def test_line_boundaries_and_labels_by_path(spark, tmp_path):
    """As ``splitlines`` cuts, but for a boundary at the very end of a file; two folders may hold one name."""
    data = "a\nb\rc\r\nd\x0be\x0cf\x1cg\x1dh\x1ei\x85j\u2028k\u2029l\x0b\n\nm".encode() + b"\xff\n"
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "app.log").write_bytes(data)
    (tmp_path / "y" / "other+1.log").write_bytes(b"only\n")
    want = data.decode(errors="replace").splitlines()
    assert [r[0] for r in read_logs(spark, str(tmp_path / "x")).select("value").collect()] == want
    labels = {str(tmp_path / "x" / "app.log"): "X", "app.log": "any", "other+1.log": "O"}
    got = read_logs(spark, f"{tmp_path}/*", labels).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in got} == {"X": len(want), "any": len(want), "O": 1}
    table = spark.createDataFrame([(f"file://{tmp_path}/y/app.log", "Y")], "file string, label string")
    assert {r[0] for r in read_logs(spark, f"{tmp_path}/*", table).select("source").distinct().collect()} == {"Y", "app", "other+1"}


@pytest.mark.parametrize("kind", ["text", "csv", "json"])
def test_ordered_export(spark, tmp_path, kind):
    """Parts in name order hold the sorted table, equal rows included; the manifest counts them."""
    from logweave.sources.logs import write_ordered

    rows = [(f"2024-01-01 00:00:{(i * 37) % 50:02d}", "INFO", "s", f"m{i % 40}", [str(i)]) for i in range(300)] * 2
    df = spark.createDataFrame(rows, "time string, level string, service string, msg string, detected array<string>").repartition(5)
    path = f"{tmp_path}/out"
    manifest = write_ordered(df, path, ["time", "msg"], kind, parts=4).orderBy("part").collect()
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    assert [m["file"] for m in manifest] == [p.name for p in parts] and len(parts) > 1
    assert sum(m["rows"] for m in manifest) == 600 and [m["first_row"] for m in manifest][0] == 0
    got = []
    for p, m in zip(parts, manifest):
        lines = p.read_text().splitlines()[1 if kind == "csv" else 0 :]
        assert len(lines) == m["rows"] and len(got) == m["first_row"]
        got += lines
    key = {"text": lambda x: (x[:19], x.split(" - ")[1]), "csv": lambda x: (x.split(",")[0], x.split(",")[3]), "json": lambda x: (__import__("json").loads(x)["time"], __import__("json").loads(x)["msg"])}[kind]
    assert [key(x) for x in got] == sorted((r[0], r[3]) for r in rows)


def test_totals_of_the_writing_job(spark, tmp_path):
    from logweave.operators.process import process, write_processed
    from logweave.operators.views import run_totals

    raw = spark.createDataFrame([("2024-01-01 00:00:00 [INFO] [s] - tel 13812345678",), ("nothing",), ("a@b.com 13812345678",)], "value string")
    processed = process(raw, C.RedactionConfig())
    got = write_processed(processed, lambda df: write_json(df, f"{tmp_path}/o")).first()
    assert tuple(got)[:4] == tuple(run_totals(processed).first())
    assert got["entity_lines"][C.PHONE] == 2 and got["entity_lines"][C.EMAIL] == 1 and got["entity_lines"][C.IP] == 0
    assert spark.read.json(f"{tmp_path}/o").count() == 3


def test_stream_anomaly_windows_match_batch(spark, tmp_path):
    """Micro-batches in no order of time; a line far ahead closes the last run."""
    import random

    from logweave.operators import events
    from logweave.streaming.logs import stream_anomaly_windows

    rng = random.Random(3)
    rows = []
    for minute in range(0, 600, 2):
        bad = (minute // 10) % 7 in (1, 2, 4)
        rows.append((f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00", "ERROR" if bad else "INFO", "s", "m"))
    rng.shuffle(rows)
    schema = "time string, level string, service string, msg string"
    for i in range(5):
        spark.createDataFrame(rows[i::5], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    spark.createDataFrame([("2030-01-01 00:00:00", "INFO", "s", "m")], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    out = stream_anomaly_windows(lines, 10, 0.5, watermark_minutes=1000)
    run = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = events.anomaly_windows(events.classified_timeline(spark.createDataFrame(rows, schema)), 10, 0.5)
    assert got == {tuple(r) for r in batch.collect()} and len(got) > 10
