"""Analyses against brute-force Python twins on small random inputs."""

import math
import random
from bisect import bisect_left, bisect_right
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave import config as C
from logweave.operators import correlate, events, flow, latency

T0 = datetime(2024, 1, 1, 0, 0, 0)


def _fmt(t):
    return t.strftime("%Y-%m-%d %H:%M:%S")


def _random_logs(seed, n=400, sources=("a", "b", "c"), span_s=3 * 3600, burst=True):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        s = rnd.choice(sources)
        sec = rnd.randrange(span_s)
        if burst and rnd.random() < 0.3:
            sec = 1800 + rnd.randrange(20)  # a dense burst, many equal times
        lvl = rnd.choice(["ERROR", "INFO", "WARN", "DEBUG", "INFO"])
        code = rnd.choice(["200", "404", "500", "200"])
        rows.append((i, s, _fmt(T0 + timedelta(seconds=sec)), lvl, f"com.x.svc{rnd.randrange(3)}",
                     f"req took {rnd.randrange(1, 300)}ms status {code} id {1700000000000 + rnd.randrange(40)}"))
    rows.append((n, "a", "1970-01-01 00:00:00", "ERROR", "unknown", "untimed line"))
    rows.append((n + 1, "b", "not a time", "ERROR", "unknown", "bad time"))
    return rows


SCHEMA = "event_id long, source string, time string, level string, service string, msg string"


def _df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _is_err(level, msg):
    import re

    return level.upper() in C.ERROR_LEVELS or re.search(r"\b[45]\d{2}\b", msg) is not None


def _parse(t):
    try:
        return datetime.strptime(t, "%Y-%m-%d %H:%M:%S")
    except ValueError:
        return None


def _cascades_twin(rows, window, min_count):
    ts = {}
    for _, s, t, lvl, _, msg in rows:
        dt = _parse(t)
        if dt is not None and _is_err(lvl, msg):
            ts.setdefault(s, []).append((dt - datetime(1970, 1, 1)).total_seconds())
    for s in ts:
        ts[s].sort()
    out = {}
    for a in ts:
        for b in ts:
            if a == b:
                continue
            lags = []
            for t in ts[a]:
                lo, hi = bisect_left(ts[b], t), bisect_right(ts[b], t + window)
                if lo < hi:
                    lags.append(ts[b][lo] - t)
            if len(lags) >= min_count:
                out[(a, b)] = (len(lags), len(ts[a]), round(float(np.mean(lags)), 6),
                               round(float(np.median(lags)), 6), round(float(np.min(lags)), 6))
    return out


@pytest.mark.parametrize("seed,window", [(1, 60), (2, 600), (3, 5), (4, 61), (5, 300)])
def test_error_cascades_twin(spark, seed, window):
    rows = _random_logs(seed)
    got = correlate.error_cascades(_df(spark, rows), window, 2, digits=None).collect()
    got = {(r["source_a"], r["source_b"]): (r["cascades"], r["errors_a"], round(r["mean_lag_s"], 6),
                                            round(r["median_lag_s"], 6), round(r["min_lag_s"], 6)) for r in got}
    assert got == _cascades_twin(rows, window, 2)


def test_rate_correlation_matches_numpy(spark):
    rows = _random_logs(7, burst=False)
    got = {(r["source_a"], r["source_b"]): r["r"] for r in correlate.rate_correlation(_df(spark, rows), 10, digits=None).collect()}
    series = {}
    for _, s, t, *_ in rows:
        dt = _parse(t)
        if dt is None:
            continue
        b = int((dt - datetime(1970, 1, 1)).total_seconds()) // 600
        series.setdefault(s, {}).setdefault(b, 0)
        series[s][b] += 1
    buckets = sorted({b for v in series.values() for b in v})
    srcs = sorted(series)
    mat = np.array([[series[s].get(b, 0) for b in buckets] for s in srcs], dtype=float)
    want = np.corrcoef(mat)
    for i, a in enumerate(srcs):
        for j, b in enumerate(srcs):
            assert got[(a, b)] == pytest.approx(want[i, j], abs=1e-9)


def test_shared_ids_twin(spark):
    rows = _random_logs(11)
    got = correlate.shared_ids(_df(spark, rows), top=None).collect()
    import re

    occ = {}
    for _, s, t, _, _, msg in rows:
        dt = _parse(t)
        if dt is None:
            continue
        for m in re.finditer("|".join(C.DEFAULT_ID_PATTERNS), msg):
            occ.setdefault(m.group(), []).append((s, dt))
    want = {k: (", ".join(sorted({s for s, _ in v})), len({s for s, _ in v}), len(v)) for k, v in occ.items() if len({s for s, _ in v}) >= 2}
    assert {r["id"]: (r["sources"], r["n_sources"], r["n_occurrences"]) for r in got} == want
    top = correlate.shared_ids(_df(spark, rows), top=5).collect()
    assert len(top) == min(5, len(want))


def test_timeline_density_anomalies_downsample(spark):
    rows = _random_logs(5, n=2000)
    df = _df(spark, rows)
    cl = events.classified_timeline(df)
    assert cl.count() == len(rows) - 1  # the unparsable time is dropped, 1970 is kept
    dens = {r["bucket"]: (r["events"], r["errors"]) for r in events.event_density(cl, 30).collect()}
    assert sum(v[0] for v in dens.values()) == len(rows) - 1
    wins = events.anomaly_windows(cl, 10, 0.5).orderBy("start").collect()
    bad = sorted(r["bucket_index"] for r in events.anomaly_buckets(cl, 10, 0.5).collect())
    # islands of consecutive bad buckets, computed in Python
    isl = []
    for k in bad:
        if isl and k - isl[-1][1] == 1:
            isl[-1][1] = k
        else:
            isl.append([k, k])
    assert [(r["start"], r["end"]) for r in wins] == [
        (datetime(1970, 1, 1) + timedelta(minutes=10 * a), datetime(1970, 1, 1) + timedelta(minutes=10 * (b + 1))) for a, b in isl
    ]
    timed = events.with_event_time(df).select("event_id", "ts")
    got = sorted(r["event_id"] for r in events.downsample(timed, ["ts", "event_id"], 300).collect())
    order = sorted(((_parse(t), i) for i, _, t, *_ in rows if _parse(t) is not None))
    step = len(order) // 300
    assert got == sorted(i for _, i in order[::step])


def test_classify_and_lanes(spark):
    df = spark.createDataFrame(
        [(1, "s", "svc", "INFO", "GET /a 404"), (2, "s", "svc", "ERROR", "boom"), (3, "s", "svc", "INFO", "publish to topic"),
         (4, "s", "svc", "WARNING", "slow"), (5, "s", "svc", "INFO", "took 450 ms"), (6, "s", "svc", "INFO", "user login success"),
         (7, "t", "svc", "INFO", "feign call")],
        "event_id int, source string, service string, level string, msg string",
    )
    custom = [C.EventType("custom_0", "Mine", keywords=["boom"])]
    got = {r["event_id"]: r["event_type"] for r in events.classify_event(df, custom).collect()}
    assert got == {1: "http_4xx", 2: "custom_0", 3: "mq", 4: "warn", 5: "http_4xx", 6: "auth_ok", 7: "auth_ok"}
    lanes = {r["event_id"]: r["lane"] for r in events.assign_lane(df, [C.LaneRule("FEIGN", "rpc"), C.LaneRule("[bad", "x")], "source_service").collect()}
    assert lanes[7] == "t › rpc" and lanes[1] == "s › svc"
    assert {r["lane"] for r in events.assign_lane(df, [], "source").collect()} == {"s", "t"}


def test_latency_summary_matches_numpy(spark):
    rows = _random_logs(9, n=600)
    samples = latency.extract_latency(_df(spark, rows))
    got = {r["service"]: r for r in latency.latency_summary(samples, digits=None).collect()}
    vals = {}
    import re

    for _, s, _, _, svc, msg in rows:
        m = re.search(r"(?:duration|elapsed|took|latency|cost)[=:\s]+(\d+(?:\.\d+)?)\s*ms", msg, re.I)
        if m:
            vals.setdefault(f"{s} › {'.'.join(svc.split('.')[-2:])}", []).append(float(m.group(1)))
    assert set(got) == set(vals)
    for k, v in vals.items():
        for q, col in ((50, "p50_ms"), (95, "p95_ms"), (99, "p99_ms")):
            assert got[k][col] == pytest.approx(np.percentile(v, q), abs=1e-9)
        assert got[k]["mean_ms"] == pytest.approx(np.mean(v)) and got[k]["samples"] == len(v)


def test_flow_single_and_multi(spark):
    df = spark.createDataFrame([("a", "com.x.svc", "info"), ("a", "svc2", "TRACE"), ("b", "com.x.svc", "ERROR")],
                               "source string, service string, level string")
    e = {(r["layer"], r["src"], r["dst"]): r["n"] for r in flow.service_flow(df).collect()}
    assert e == {("source_service", "a", "x.svc"): 1, ("source_service", "a", "svc2"): 1, ("source_service", "b", "x.svc"): 1,
                 ("service_level", "x.svc", "INFO"): 1, ("service_level", "svc2", "OTHER"): 1, ("service_level", "x.svc", "ERROR"): 1}
    single = flow.service_flow(df.where(F.col("source") == "a"), multi=False).collect()
    assert {r["layer"] for r in single} == {"service_level"}
    nodes = {(r["kind"], r["node"]): r["n"] for r in flow.flow_nodes(flow.service_flow(df)).collect()}
    assert nodes[("source", "a")] == 2 and nodes[("service", "x.svc")] == 2 and nodes[("level", "OTHER")] == 1


def test_exact_percentiles_plan(spark):
    from logweave.plans.quantiles import exact_percentiles

    rnd = random.Random(3)
    rows = []
    for g in range(6):
        for _ in range(rnd.randrange(1, 300)):
            v = rnd.choice([0.0, -1.5, 2.0, rnd.uniform(-1e4, 1e4), rnd.expovariate(0.01), 1e-9, 123456.789])
            rows.append((g, v, rnd.randrange(1, 4)))
    df = spark.createDataFrame(rows, "g int, v double, w long")
    ps = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    got = {r["g"]: [r[f"p_{i}"] for i in range(len(ps))] for r in exact_percentiles(df, ["g"], "v", ps, weight="w", bins_per_octave=4).collect()}
    for g in {r[0] for r in rows}:
        expanded = [v for gg, v, w in rows if gg == g for _ in range(w)]
        want = [float(np.percentile(expanded, p * 100)) for p in ps]
        assert got[g] == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_event_time_formats(spark):
    vals = ["2024-01-01 12:00:00", "2024-01-01T12:00:00Z", "2024-01-01T12:00:00.5+08:00", "2024-01-01 12:00:00,123",
            "2024-01-01", "12:00:00.000", "01/Jan/2024:12:00:00 +0000", "Jan 01 12:00:00", "garbage", "1970-01-01 00:00:00"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, time string")
    got = {r["i"]: r["ts"] for r in df.select("i", events.event_time(F.col("time")).alias("ts")).collect()}
    assert got[0] == datetime(2024, 1, 1, 12) and got[1] == datetime(2024, 1, 1, 12)
    assert got[2] == datetime(2024, 1, 1, 4, 0, 0, 500000) and got[3] == datetime(2024, 1, 1, 12, 0, 0, 123000)
    assert got[4] == datetime(2024, 1, 1) and got[9] == datetime(1970, 1, 1)
    assert got[5] is None and got[6] is None and got[7] is None and got[8] is None
    ext = df.select("i", events.event_time(F.col("time"), base_date="2024-02-02", extra_formats=["dd/MMM/yyyy:HH:mm:ss Z"]).alias("ts"))
    got = {r["i"]: r["ts"] for r in ext.collect()}
    assert got[5] == datetime(2024, 2, 2, 12) and got[6] == datetime(2024, 1, 1, 12)
    timed = events.with_event_time(df, include_untimed=False)
    assert sorted(r["i"] for r in timed.collect()) == [0, 1, 2, 3, 4]


def test_latency_approx_and_report(spark):
    rows = _random_logs(13, n=500)
    samples = latency.extract_latency(_df(spark, rows))
    exact = {r["service"]: r for r in latency.latency_summary(samples).collect()}
    points = latency.latency_points(_df(spark, rows))
    timed = {r["service"]: r for r in latency.latency_summary(points.select("service", "latency_ms")).collect()}
    merged = latency.sketch_summary(latency.latency_sketches(points, 7)).collect()
    assert {r["service"] for r in merged} == set(timed) <= set(exact)
    for r in merged:  # fewer samples than the sketch holds: nothing is lost in a merge
        assert r["samples"] == timed[r["service"]]["samples"] and r["max_ms"] == timed[r["service"]]["max_ms"]
        assert abs(r["p50_ms"] - timed[r["service"]]["p50_ms"]) <= 0.05 * max(1.0, r["max_ms"])
    rep = [r["p95_ms"] for r in latency.latency_report(_df(spark, rows)).collect()]
    assert rep == sorted(rep)


def test_cascade_matrix_and_nodes(spark):
    rows = _random_logs(2)
    casc = correlate.error_cascades(_df(spark, rows), 600)
    m = {(r["source_a"], r["source_b"]): r["cascades"] for r in correlate.cascade_matrix(casc).collect()}
    got = {(r["source_a"], r["source_b"]): r["cascades"] for r in casc.collect()}
    names = {a for a, _ in got} | {b for _, b in got}
    assert set(m) == {(a, b) for a in names for b in names}
    assert all(m[k] == got.get(k, 0) for k in m)
    counts = [r["cascades"] for r in casc.collect()]
    assert counts == sorted(counts, reverse=True)


def test_degenerate_sources(spark):
    import math

    # over the union of buckets (0, 1, 2) "a" is constant [1, 1, 1]; "b" is [2, 1, 1]
    rows = [(1, "a", "2024-01-01 00:00:00", "ERROR", "s", "x"), (2, "a", "2024-01-01 01:00:00", "ERROR", "s", "x"),
            (7, "a", "2024-01-01 02:30:00", "ERROR", "s", "x"),
            (3, "b", "2024-01-01 00:00:00", "ERROR", "s", "x"), (4, "b", "2024-01-01 00:10:00", "ERROR", "s", "x"),
            (5, "b", "2024-01-01 01:00:00", "ERROR", "s", "x"), (6, "b", "2024-01-01 02:00:00", "ERROR", "s", "x")]
    df = _df(spark, rows)
    r = {(x["source_a"], x["source_b"]): x["r"] for x in correlate.rate_correlation(df, 60).collect()}
    assert math.isnan(r[("a", "a")]) and math.isnan(r[("a", "b")]) and r[("b", "b")] == 1.0
    one = df.where(F.col("source") == "b")
    assert correlate.rate_correlation(one, 60).count() == 0
    assert correlate.error_cascades(one, 600).count() == 0
    assert correlate.shared_ids(one).count() == 0


def test_custom_type_may_reuse_a_default_name(spark):
    df = spark.createDataFrame([("INFO", "all fine"), ("ERROR", "x"), ("debug", "")], "level string, msg string")
    types = [C.EventType("error", "Trouble", keywords=["fine"]), C.EventType("any", "Any", keywords=["boom|"], levels=["debug"])]
    got = [(r["event_type"], r["event_display"]) for r in events.classify_event(df, types).collect()]
    assert got == [("error", "Trouble"), ("any", "Any"), ("any", "Any")]
    rules = [C.LaneRule(".*", "everything")]
    df = df.withColumn("service", F.lit("s"))
    assert {r["lane"] for r in events.assign_lane(df, rules).collect()} == {"everything"}


def test_large_counts_and_constant_series_correlate_exactly(spark):
    rows = [("a", m, 10**9 + m) for m in range(5)] + [("b", m, 10**9 + (m * 3) % 5) for m in range(5)] + [("c", m, 10**8) for m in range(5)]
    df = spark.createDataFrame([(s, f"2024-01-01 00:{m:02d}:00", n) for s, m, n in rows], "source string, time string, n long")
    got = {(r["source_a"], r["source_b"]): r["r"] for r in correlate.rate_correlation(df, 1, digits=6, weight_col="n").collect()}
    want = np.corrcoef(range(5), [(m * 3) % 5 for m in range(5)])[0, 1]
    assert got["a", "a"] == 1.0 and got["a", "b"] == got["b", "a"] == round(want, 6)
    assert all(math.isnan(got[p]) for p in got if "c" in p) and len(got) == 9


def test_sampling_spreads_equal_times_and_counts_equal_rows(spark):
    df = spark.range(4000).selectExpr("id as event_id", "timestamp'1970-01-01' as ts")
    assert events.downsample_every(df, 3, ["ts"]).distinct().count() == 1334
    same = spark.createDataFrame([("x", 1)] * 10, "time string, n int")
    assert events.downsample_every(same, 5, ["time"]).count() == 2
    assert events.downsample(same, ["time"], 3).count() == 4 and events.downsample(same, ["time"], 10).count() == 10
    assert sorted(r["event_id"] for r in events.downsample_every(df, 7, ["ts", "event_id"]).collect()) == list(range(0, 4000, 7))
    from logweave.plans.rank import global_rank

    ranked = global_rank(df, ["ts", "event_id"])
    busy = df.repartitionByRange(8, "ts", "event_id").select(F.spark_partition_id().alias("p")).distinct().count()
    assert busy > 4 and ranked.where("rank != event_id").count() == 0


def test_time_forms_the_line_formats_accept(spark):
    forms = ["2024-1-5 9:03:01", "2024-01-05T0903", "2024/01/05 09:03:01", "2024-01-05 09:03", "2024-01-05T09:03:01.250+08:00", "nonsense", None]
    df = spark.createDataFrame([(t,) for t in forms], "time string")
    got = [r["ts"] for r in events.with_event_time(df).collect()]
    assert len(got) == 5 and got[0] == got[2] == datetime(2024, 1, 5, 9, 3, 1) and got[1] == got[3] == datetime(2024, 1, 5, 9, 3)


def test_search_sees_unicode_words(spark):
    from logweave.operators import views

    df = spark.createDataFrame([("用户张三登录成功",), ("用户 登录",)], "msg string")
    assert views.search_msg(df, r"用户\w+登录").count() == 1


def test_merged_view_keeps_equal_rows_apart(spark):
    from logweave.operators import views

    rows = [("t1", "m", ["x"]), ("t1", "m", ["x"]), ("t0", "m", None), (None, None, None)]
    df = spark.createDataFrame(rows, "time string, msg string, detected array<string>")
    got = views.merged_view(df, rank_col="place").orderBy("place").collect()
    assert [(r["place"], r["time"]) for r in got] == [(0, None), (1, "t0"), (2, "t1"), (3, "t1")]
    assert sorted((tuple(r)[:3] for r in got), key=str) == sorted(rows, key=str)


def test_merged_view_keeps_rows_without_time_or_tie(spark):
    from logweave.operators import views

    rows = [("b", 2, "m1"), (None, 5, "m2"), ("a", None, "m3"), ("a", 1, "m4"), (None, None, "m5")]
    df = spark.createDataFrame(rows, "time string, event_id long, msg string")
    out = views.merged_view(df, ["event_id"], rank_col="place")
    assert out.columns == ["time", "event_id", "msg", "place"]
    want = [r["msg"] for r in views.merged_view(df, ["event_id"]).collect()]
    assert want == ["m5", "m2", "m3", "m4", "m1"]
    assert [(r["place"], r["msg"]) for r in out.orderBy("place").collect()] == list(enumerate(want))
