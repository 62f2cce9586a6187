import numpy as np
import pytest
from pyspark.sql import functions as F

from windowguard import constants as K
from windowguard.functions import scalars as S
from windowguard.operators import red

TRAVEL = "POST:/api/v1/travelservice/trips/left"
ROUTES = "GET:/api/v1/routeservice/routes"
PRESERVE = "POST:/api/v1/preserveservice/preserve"
T0 = 1_780_972_185_000

SPAN = "case_id string, endpoint_key string, ts_ms long, latency_ms double, is_error boolean, status_code int"


@pytest.mark.parametrize("heavy_rows", [1, 10**9])
def test_trace_red_gates_and_rates(spark, heavy_rows):
    cells = {"one": [10.0], "two": [10.0, 20.0], "five": [1.0, 2.0, 3.0, 4.0, 100.0]}
    data = []
    for endpoint, values in cells.items():
        for i, value in enumerate(values):
            status = {0: 503, 1: 404, 2: 200}.get(i)
            data.append(("c", endpoint, T0 + i, value, i == 0, status if endpoint == "five" else None))
    df = spark.createDataFrame(data, SPAN)
    got = {r["endpoint_key"]: r for r in red.trace_red(df, 15_000, heavy_rows).collect()}
    assert got["one"]["trace_latency_p50"] is None and got["one"]["trace_request_count"] == 1
    assert got["two"]["trace_latency_p50"] == 15.0 and got["two"]["trace_latency_p95"] is None
    five = got["five"]
    assert five["trace_latency_p95"] == pytest.approx(np.quantile(cells["five"], 0.95))
    assert five["trace_latency_p99"] == pytest.approx(np.quantile(cells["five"], 0.99))
    assert five["trace_latency_mean"] == 22.0
    assert five["trace_error_rate"] == pytest.approx(0.2)
    assert five["trace_5xx_rate"] == pytest.approx(1 / 3)
    assert five["trace_4xx_rate"] == pytest.approx(1 / 3)
    assert five["trace_status_coverage"] == pytest.approx(0.6)
    assert got["two"]["trace_5xx_rate"] is None and got["two"]["trace_status_coverage"] == 0
    assert five["timestamp_window_ms"] == T0


def test_missing_latency_counts_as_a_request_only(spark):
    data = [("c", "e", T0, v, False, 200) for v in (None, 1.0, 3.0)]
    got = red.trace_red(spark.createDataFrame(data, SPAN)).first()
    assert got["trace_request_count"] == 3
    assert got["trace_latency_p50"] == 2.0 and got["trace_latency_mean"] == 2.0


def test_client_red(spark):
    data = [("c", "e", T0 + i, float(i), s) for i, s in enumerate((200, 201, 404, 500))]
    df = spark.createDataFrame(
        data, "case_id string, endpoint_key string, ts_ms long, latency_ms double, status_code int"
    )
    got = red.client_red(df).first()
    assert (got["request_count"], got["error_rate"]) == (4, 0.5)
    assert (got["status_2xx_rate"], got["status_4xx_rate"], got["status_5xx_rate"]) == (0.5, 0.25, 0.25)


def red_tables(spark):
    trace = [
        (TRAVEL, T0, 8, 45595.0), (TRAVEL, T0 + 15_000, 6, 30000.0), (TRAVEL, T0 + 30_000, 7, 33000.0),
        (ROUTES, T0, 12, 900.0), ("POST:/api/v1/other", T0, 4, None),
    ]
    client = [
        (TRAVEL, T0, 12, 3100.5), (TRAVEL, T0 + 15_000, 13, 2200.0), (ROUTES, T0, 20, 1100.0),
        (PRESERVE, T0 + 45_000, 7, 4907.43), ("POST:/api/v1/inside_pay", T0, 5, 1200.0),
    ]
    t = spark.createDataFrame(
        [("N", *r) for r in trace],
        "case_id string, endpoint_key string, timestamp_window_ms long, trace_request_count long, trace_latency_p95 double",
    )
    for c in ("trace_latency_p50", "trace_error_rate", "trace_5xx_rate"):
        t = t.withColumn(c, F.lit(0.0))
    c = spark.createDataFrame(
        [("N", *r) for r in client],
        "case_id string, endpoint_key string, timestamp_window_ms long, request_count long, latency_p95 double",
    )
    for name in ("error_rate", "status_5xx_rate", "status_2xx_rate", "status_4xx_rate"):
        c = c.withColumn(name, F.lit(0.0))
    return t, c


def test_latency_divergence(spark, rows):
    trace, client = red_tables(spark)
    got = red.client_features(client, trace, K.ENDPOINT_SERVICES)
    assert rows(got, "endpoint_key", "timestamp_window_ms", "endpoint_red__latency_divergence") == sorted(
        [
            (TRAVEL, T0, -42494.5), (TRAVEL, T0 + 15_000, -27800.0), (ROUTES, T0, 200.0),
            (PRESERVE, T0 + 45_000, None),
        ], key=lambda r: tuple(map(str, r)),
    )
    alone = red.client_features(client, None, K.ENDPOINT_SERVICES)
    assert {r[0] for r in rows(alone, "endpoint_red__latency_divergence")} == {None}


def test_inner_join_whitelist_and_service(spark):
    trace, client = red_tables(spark)
    joined = red.with_service(
        red.endpoint_features(trace, client, K.ENDPOINT_SERVICES), K.ENDPOINT_SERVICES
    ).collect()
    assert {(r["endpoint_key"], r["timestamp_window_ms"]) for r in joined} == {
        (TRAVEL, T0), (TRAVEL, T0 + 15_000), (ROUTES, T0),
    }
    assert {r["service_name"] for r in joined} == {"ts-travel-service", "ts-route-service"}
    assert red.trace_features(trace, K.ENDPOINT_SERVICES).count() == 4


def test_endpoint_table_works_like_a_map(spark, rows):
    trace, _ = red_tables(spark)
    table = spark.createDataFrame([(TRAVEL, "svc")], "endpoint_key string, service_name string")
    assert red.keep_endpoints(trace, table).count() == 3
    got = red.with_service(trace, table).select("endpoint_key", "service_name").distinct()
    assert dict(rows(got))[ROUTES] is None and dict(rows(got))[TRAVEL] == "svc"


def test_fuse_report(spark):
    trace, client = red_tables(spark)
    got = red.fuse_report(trace, client.unionByName(client.limit(1))).first()
    assert (got["trace_cells"], got["client_cells"], got["fused_cells"], got["repeated_keys"]) == (5, 5, 3, 1)
    assert got["hit_rate"] == pytest.approx(0.6)


def test_entry_spans(spark, rows):
    span = "struct<type:string,endpoint_name:string,start_ms:long,latency_ms:double,is_error:boolean,status_code:int>"
    data = [
        ("t1", [("Entry", "GET:/a/12", 1, 1.0, False, 200), ("Exit", "GET:/b", 2, 1.0, False, 200)], ([],)),
        ("t2", [("Entry", "Mysql", 3, 1.0, True, None), ("Entry", "", 4, 1.0, True, None)], (["x", "POST:/b/c"],)),
        ("t3", [("Entry", "Mysql", 5, 1.0, True, None)], (["x"],)),
        ("t4", None, None),
    ]
    df = spark.createDataFrame(
        data, f"trace_id string, spans array<{span}>, summary struct<endpoint_names:array<string>>"
    )
    assert rows(red.entry_spans(df), "trace_id", "endpoint_key", "ts_ms") == [
        ("t1", "GET:/a/{id}", 1), ("t2", "POST:/b/c", 3),
    ]


@pytest.mark.parametrize(
    "url, path",
    [
        ("http://localhost:30467/api/v1/users/login", "/api/{param}/users/login"),
        ("/orders/42?x=1#y", "/orders/{id}"),
        ("/a/6F9619FF-8B86-D011-B42D-00CF4FC964FF/b", "/a/{uuid}/b"),
        ("/inside_pay_service/minStation/trips", "/inside_pay_service/minStation/trips"),
        ("/x/Zk9-77", "/x/{param}"),
        ("https://host", ""),
    ],
)
def test_normalize_path(spark, url, path):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(S.normalize_path(F.col("u"))).first()[0] == path


def test_known_segments_stay(spark):
    df = spark.createDataFrame([("/api/v1/travel2service",)], "u string")
    got = df.select(S.endpoint_key(F.lit("post"), F.col("u"), ["v1", "travel2service"])).first()[0]
    assert got == "POST:/api/v1/travel2service"


def test_requests(spark):
    df = spark.createDataFrame(
        [("2026-06-09T02:29:46Z", "get", "http://h/a/1", 200, 7.5)],
        "timestamp string, method string, url string, status_code int, latency_ms double",
    )
    got = red.requests_of(df).first()
    assert (got["endpoint_key"], got["ts_ms"]) == ("GET:/a/{id}", 1_780_972_186_000)


def test_window_density(spark):
    data = [("c", "e", T0 + 1000 * i, 1.0, False, None) for i in range(12)]
    got = red.window_density(spark.createDataFrame(data, SPAN), (5_000, 15_000)).orderBy("window_ms").collect()
    assert [(r["window_ms"], r["cells"], r["p95_null_rate"], r["median_requests"]) for r in got] == [
        (5_000, 3, pytest.approx(1 / 3), 5.0), (15_000, 1, 0.0, 12.0),
    ]


def test_buckets_floor_below_zero(spark):
    got = spark.sql("SELECT -7 AS a, 14999 AS b, 15000 AS c").select(
        S.bucket(F.col("a")), S.bucket(F.col("b")), S.bucket(F.col("c"))
    )
    assert tuple(got.first()) == (-15_000, 0, 15_000)
