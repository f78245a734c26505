"""Operators on small vectors with known results."""

import random

import pytest
from pyspark.sql import functions as F

from barwright.functions import interval as iv
from barwright.functions import logic, names
from barwright.operators import catalog, display, indicators, windows
from barwright.operators.dedup import keep_one, merge
from barwright.operators.resample import resample
from barwright.plans import study
from barwright.plans.study import Node, Study, StudyError
from barwright.sources import candles as cs
from barwright.streaming import bars as streams

KEY = ("bybit", "spot", "BTCUSDT", "1min")
T = 1700000000000
MIN = 60_000


def ramp(n, t0, symbol="BTCUSDT"):
    return [("bybit", "spot", symbol, "1min", t0 + i * MIN, 100.0 + i, 101.0 + i, 99.0 + i, 100.5 + i, 1000.0) for i in range(n)]


def closes(spark, values):
    return cs.in_memory(spark, [(*KEY, i * MIN, v, (v or 0) + 1.0, (v or 0) - 1.0, v, 10.0 + i) for i, v in enumerate(values)])


def column(df, name):
    return [r[0] for r in df.orderBy("timestamp").select(F.col(f"`{name}`")).collect()]


def near(got, want):
    return all((g is None) == (w is None) and (g is None or abs(g - w) < 1e-6) for g, w in zip(got, want)) and len(got) == len(want)


SERIES = [10, 11, 10.5, 12, 11, 13, 12.5, 12.5]


@pytest.mark.parametrize(
    "make, want",
    [
        (lambda d: d.withColumn("y", indicators.sma(F.col("close"), 3)), [None, None, 10.5, 11.166667, 11.166667, 12, 12.166667, 12.666667]),
        (lambda d: indicators.ema(d, "close", 3, "y"), [None, None, 10.5, 11.25, 11.125, 12.0625, 12.28125, 12.390625]),
        (lambda d: indicators.rsi(d, "close", 3, "y"), [None, None, None, 83.333333, 55.555556, 77.777778, 65.497076, 65.497076]),
        (lambda d: indicators.ema(d, "close", 1, "y"), SERIES),
        (lambda d: indicators.ema(d, "close", 9, "y"), [None] * 8),
        (lambda d: indicators.rsi(d, "close", 8, "y"), [None] * 8),
    ],
)
def test_indicator_vectors(spark, make, want):
    assert near(column(make(closes(spark, [float(v) for v in SERIES])), "y"), want)


def test_indicator_skips_leading_nulls(spark):
    got = column(indicators.ema(closes(spark, [None, None, *map(float, SERIES)]), "close", 3, "y"), "y")
    assert near(got, [None] * 4 + [10.5, 11.25, 11.125, 12.0625, 12.28125, 12.390625])


def test_chunks_match_a_loop_and_flat_stretches_keep_rsi(spark):
    rnd, x = random.Random(1), [100.0]
    for _ in range(1500):
        x.append(x[-1] + rnd.gauss(0, 1))
    x += [x[-1]] * 1500
    k, y, want = 2 / 15, sum(x[:14]) / 14, [None] * 13
    for i in range(13, len(x)):
        y = y if i == 13 else k * x[i] + (1 - k) * y
        want.append(y)
    d = closes(spark, x)
    assert near(column(indicators.ema(d, "close", 14, "y"), "y"), want)
    g = loss = 0.0
    rsi = [None] * 14
    steps = [b - a for a, b in zip(x, x[1:])]
    for i in range(14, len(x)):
        if i == 14:
            g, loss = sum(max(s, 0) for s in steps[:14]) / 14, sum(max(-s, 0) for s in steps[:14]) / 14
        else:
            g, loss = (13 * g + max(steps[i - 1], 0)) / 14, (13 * loss + max(-steps[i - 1], 0)) / 14
        rsi.append(100 * g / (g + loss))
    assert near(column(indicators.rsi(d, "close", 14, "y"), "y"), rsi)


@pytest.mark.parametrize("period", [0, -1, None, 2.5, True])
def test_period_is_checked(period):
    with pytest.raises(ValueError):
        indicators.check_period(period)


@pytest.mark.parametrize(
    "fn, left, right, want",
    [
        ("crossover", [None, 10, 10, 10, 15, 22.5], [None, None, 10, 10, 13.33, 18.33], [None, None, None, False, True, False]),
        ("crossunder", [None, 25, 25, 25, 25, 17.5, 7.5], [None, None, 25, 25, 25, 20, 13.33], [None, None, None, False, False, True, False]),
        ("crossover", [None, 1, None, 3], [None, 2, 2, 2], [None] * 4),
        ("gt", [None, 3, 2, 5], [None, 2, 2, 5], [None, True, False, False]),
        ("lt", [None, 1, 2, 5], [None, 2, 2, 5], [None, True, False, False]),
        ("and_", [None, True, True, False, False, True], [None, False, True, False, None, None], [None, False, True, False, None, None]),
        ("or_", [None, True, False, False, False, True], [None, False, True, False, None, None], [None, True, True, False, None, None]),
    ],
)
def test_signals(spark, fn, left, right, want):
    kind = "boolean" if fn in ("and_", "or_") else "double"
    cast = (lambda v: v) if kind == "boolean" else (lambda v: None if v is None else float(v))
    rows = [(*KEY, i, cast(a), cast(b)) for i, (a, b) in enumerate(zip(left, right))]
    df = spark.createDataFrame(rows, f"exchange string, category string, symbol string, interval string, timestamp long, l {kind}, r {kind}")
    make = getattr(logic, fn)
    args = (indicators.in_series(),) if fn.startswith("cross") else ()
    assert column(df.withColumn("y", make(F.col("l"), F.col("r"), *args)), "y") == want


def test_resample(spark):
    got = [tuple(r)[4:] for r in resample(cs.in_memory(spark, ramp(12, 0)), "5m").orderBy("timestamp").collect()]
    assert got == [(0, 100, 105, 99, 104.5, 5000), (300000, 105, 110, 104, 109.5, 5000), (600000, 110, 112, 109, 111.5, 2000)]


@pytest.mark.parametrize("small, large", [("5m", "15m"), ("1h", "1d"), ("1d", "1w"), ("1mo", "1y")])
def test_resample_twice_is_resample_once(spark, small, large):
    base = cs.in_memory(spark, [r for r in ramp(4000, T)][::7])
    rows = lambda d: sorted(tuple(r)[4:] for r in d.collect())
    assert rows(resample(resample(base, small), large)) == rows(resample(base, large))


@pytest.mark.parametrize("text, want", [("1M", "1min"), ("1mo", "1mo"), (" 4Hours ", "4h"), ("2week", "2w"), ("1Y", "1y"), ("1hr", "1h"), ("3WK", "3w"), ("2yr", "2y"), ("4294967295s", "4294967295s")])
def test_interval_parse(text, want):
    assert str(iv.Interval.parse(text)) == want


@pytest.mark.parametrize("text", ["", "m", "0m", "1parsec", "-1m", "4 Hours", "4294967296s"])
def test_interval_refused(text):
    with pytest.raises(ValueError):
        iv.Interval.parse(text)


def test_week_starts_monday_and_months_clamp(spark):
    row = spark.range(1).select(
        iv.Interval.parse("1w").bucket(F.lit(1717804800000)).alias("w"),
        iv.Interval.parse("1mo").shift(F.lit(1706659200000), 1).alias("m"),
    ).first()
    assert (row["w"], row["m"]) == (1717372800000, 1709164800000)  # 2024-06-03; 31 January -> 29 February


@pytest.mark.parametrize(
    "start, end, limit, interval, low, high, want",
    [
        (None, None, 500, "1m", T - 1000 * MIN, T, (T - 550 * MIN, T, 500)),
        (None, None, None, "1m", T - 1050 * MIN, T, (T - 1050 * MIN, T, 1000)),
        (None, T, 500, "1h", T - 60000 * MIN, T + 60 * MIN, (T - 550 * 60 * MIN, T, 500)),
        (1000, 2000, None, "1m", None, None, (1000, 2000, None)),
        (1000, 2000, 100, "1m", None, None, (1000, 2000, 100)),
        (None, None, 500, "1m", 1000000 - 100 * MIN, 1000000, (1000000 - 100 * MIN, 1000000, 500)),
        (2000, 1000, 100, "1m", None, None, None),
        (None, None, 100, "1m", None, None, None),
        (T, None, 20, "1m", None, None, (T, T + 70 * MIN, 20)),
    ],
)
def test_windows(spark, start, end, limit, interval, low, high, want):
    df = spark.createDataFrame([(start, end, limit, low, high)], "start long, end long, limit long, from long, to long")
    r = windows.resolve(df, interval).first()
    assert (r["error"] is None) == (want is not None)
    assert want is None or (r["start_ms"], r["end_ms"], r["row_limit"]) == want


def test_load_keeps_the_last_rows_of_the_window(spark):
    held = cs.in_memory(spark, ramp(120, 0))
    request = spark.createDataFrame([(*KEY, 0, None, 20)], "exchange string, category string, symbol string, interval string, start long, end long, limit long")
    assert column(windows.load(held, request), "timestamp") == [i * MIN for i in range(51, 71)]


def test_requests_for_one_series_are_answered_each(spark):
    path = cs.scratch(spark)
    cs.write(cs.in_memory(spark, ramp(60, 0) + ramp(60, 9 * cs.DAY_MS)), path)
    kind = "exchange string, category string, symbol string, interval string, start long, end long, limit long, n int"
    requests = spark.createDataFrame([(*KEY, 0, 59 * MIN, None, 1), (*KEY, 0, 59 * MIN, None, 2), (*KEY, 0, 59 * MIN, 7, 3), (*KEY, 9, 3, None, 4)], kind)
    bounds = catalog.time_bounds(cs.scan(spark, path))
    for got in (windows.load(cs.scan(spark, path), requests, "1h", "n"), windows.load_stored(spark, path, requests, bounds, "1h", "n")):
        assert sorted((r["n"], r["timestamp"], r["volume"]) for r in got.collect()) == [(k, 0, 60000.0) for k in (1, 2, 3)]
    minutes = windows.load_stored(spark, path, requests, bounds, "1min", "n")
    assert sorted(r["n"] for r in minutes.collect()) == [1] * 60 + [2] * 60 + [3] * 7
    assert windows.load(cs.scan(spark, path), requests.where("n < 3"), "1h").count() == 1
    days = minutes._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "1970-01-01" in days and "1970-01-10" not in days
    assert windows.load_stored(spark, path, requests.where("n = 4"), bounds).count() == 0


def test_two_sources_meet_in_the_same_market(spark):
    held = cs.in_memory(spark, ramp(5, 0) + ramp(5, 0, "ETHUSDT"))
    n, span = study.Node, {"start_ms": 0, "end_ms": 10 * MIN}
    for params, rows in ((span, 10), (span | dict(zip(cs.KEYS, KEY)), 10)):
        two = study.Study("two", (n("a", study.SOURCE, span), n("b", study.SOURCE, params), n("g", "logic.gt")), (("a.close", "g.left"), ("b.close", "g.right")))
        got = study.run_study(two, study.warehouse_source(held), ["g.signal", "b.close"])
        assert got.count() == rows == got.select("symbol", "timestamp").distinct().count()


def test_values_that_are_no_numbers_give_null(spark):
    nan = float("nan")
    bars = closes(spark, [1.0, 2.0, nan, 4.0, 5.0, 7.0]).withColumn("m", indicators.sma(F.col("close"), 2))
    got = bars.select("timestamp", "m", logic.gt(F.col("close"), F.lit(0.0)).alias("g"), logic.lt(F.lit(0.0), F.col("close")).alias("l")).orderBy("timestamp").collect()
    assert [r["m"] for r in got] == [None, 1.5, None, None, 4.5, 6.0] and [r["g"] for r in got] == [r["l"] for r in got] == [True, True, None, True, True, True]


def test_store_scan_and_upsert(spark):
    days = [1717804800000 + k * cs.DAY_MS for k in range(3)]
    path = cs.scratch(spark)
    cs.write(cs.in_memory(spark, [r for d in days for r in ramp(5, d)]), path)
    keys = {"symbol": "BTCUSDT", "interval": "1min"}
    assert cs.scan(spark, path, keys, days[1], days[1] + 4 * MIN).count() == 5
    assert cs.scan(spark, path, keys, days[2] + cs.DAY_MS * 9, None).count() == 0
    plan = cs.scan(spark, path, keys, days[1], days[1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "day" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    fresh = cs.in_memory(spark, [(*KEY, days[1] + 4 * MIN, 1.0, 1.0, 1.0, 1.0, 1.0), (*KEY, days[1] + 5 * MIN, 2.0, 2.0, 2.0, 2.0, 2.0)])
    cs.upsert(spark, path, fresh)
    cs.upsert(spark, path, fresh)
    got = cs.scan(spark, path)
    assert got.count() == 16 and got.where("close = 1.0").count() == 1
    late = cs.in_memory(spark, ramp(1, days[0]))
    cs.incremental(spark, path, late.withColumn("close", F.lit(-1.0)))
    assert cs.scan(spark, path).where("close = -1.0").count() == 0
    sizes = cs.dataset_bytes(spark, path)
    row = catalog.snapshot(cs.scan(spark, path), sizes).first()
    assert row["record_count"] == 16 and row["approx_size_bytes"] > 0


def test_catalog_saved_and_loaded(spark):
    path = cs.scratch(spark)
    assert catalog.load(spark, path) is None
    held = catalog.snapshot(cs.in_memory(spark, ramp(120, T) + ramp(60, T, "ETHUSDT")))
    catalog.save(held, path)
    back = catalog.load(spark, path)
    assert sorted(map(tuple, back.select(*held.columns).collect())) == sorted(map(tuple, held.collect()))
    assert {r["version"] for r in back.collect()} == {1} and back.where("generated_at IS NULL").count() == 0
    assert catalog.totals(back.withColumn("approx_size_bytes", F.lit(5).cast("long"))).first()["bytes"] == 10
    assert [r[0] for r in catalog.market_symbols(held, "bybit", "spot").orderBy("symbol").collect()] == ["BTCUSDT", "ETHUSDT"]


def test_null_audit_raises(spark):
    with pytest.raises(ValueError, match="open holds 1"):
        catalog.require_complete(closes(spark, [1.0, None]))


def test_dedup_and_merge(spark):
    a = spark.createDataFrame([(1, 1.0, 0), (1, 2.0, 1), (2, 3.0, 0)], "timestamp long, close double, n int")
    assert sorted(r["close"] for r in keep_one(a, ["timestamp"], "n", "first").collect()) == [1.0, 3.0]
    assert sorted(r["close"] for r in merge(a.where("n = 0"), a.where("n = 1"), ["timestamp"]).collect()) == [2.0, 3.0]
    with pytest.raises(ValueError):
        keep_one(a, ["timestamp"], "n", "middle")


def test_pages_and_plan(spark):
    good = '{"retCode":0,"retMsg":"OK","result":{"symbol":"B","category":"linear","list":[["1","2","3","4","5","6","7"],["x","2","3","4","5","6","7"]]}}'
    df = spark.createDataFrame([(good,), ('{"retCode":10001,"retMsg":"bad"}',), ("nonsense",)], "body string")
    ok, bad = cs.decode_pages(df)
    assert [tuple(r) for r in ok.collect()] == [("B", "linear", 1, 2.0, 3.0, 4.0, 5.0, 6.0)] and bad.count() == 3
    spans = spark.createDataFrame([(30_000, 150_000), (120_000, 60_000)], "start long, end long")
    assert [tuple(r)[2:] for r in cs.fetch_plan(spans, 2).orderBy("low").collect()] == [(0, 60_000)]
    row = spark.range(1).select(names.product_class(F.lit("futures_inverse")), names.interval_code(F.lit("7h")), names.interval_code(F.lit("2d")), names.interval_code(F.lit("12hr")), names.exchange(F.lit(" Bybit ")), names.category(F.lit("Spot"))).first()
    assert tuple(row) == ("inverse", None, "D", "720", "bybit", None)


def sample(spark, values, kinds, edges, outputs):
    nodes = (Node("c", study.SOURCE, {"limit": 1000}), *kinds)
    return study.run_study(Study("s", nodes, edges), study.warehouse_source(closes(spark, [float(v) for v in values])), outputs)


SMAS = (Node("f", "indicator.sma", {"period": 2}), Node("s", "indicator.sma", {"period": 3}))
WIRES = (("c.close", "f.input"), ("c.close", "s.input"))


def test_studies(spark):
    gold = [10, 10, 10, 10, 20, 25]
    edges = (*WIRES, ("f.value", "x.fast"), ("s.value", "x.slow"), ("f.value", "g.left"), ("s.value", "g.right"), ("x.signal", "b.left"), ("g.signal", "b.right"))
    kinds = (*SMAS, Node("x", "logic.crossover"), Node("g", "logic.gt"), Node("b", "logic.and"))
    got = sample(spark, gold, kinds, edges, ["x.signal", "g.signal", "b.signal"])
    assert column(got, "x.signal") == [None, None, None, False, True, False]
    assert column(got, "g.signal")[3:] == [False, True, True]
    assert column(got, "b.signal") == [None, None, None, False, True, False]
    under = sample(spark, [25, 25, 25, 25, 25, 10, 5], (*SMAS, Node("x", "logic.crossunder")), (*WIRES, ("f.value", "x.fast"), ("s.value", "x.slow")), ["x.signal"])
    assert column(under, "x.signal")[5] is True and column(under, "x.signal").count(True) == 1
    low = sample(spark, [25, 35, 25, 40], (Node("l", "literal.number", {"value": 30}), Node("x", "logic.lt")), (("c.timestamp", "l.reference"), ("c.close", "x.left"), ("l.value", "x.right")), ["x.signal"])
    assert column(low, "x.signal") == [True, False, True, False]


@pytest.mark.parametrize(
    "kinds, edges, outputs",
    [
        (SMAS, (("f.value", "s.input"), ("s.value", "f.input")), ["s.value"]),
        (SMAS, (("c.close", "ghost.input"),), ["f.value"]),
        ((Node("n", "nope.thing"),), (), ["n.value"]),
        (SMAS, (*WIRES, ("c.open", "f.input")), ["f.value"]),
        (SMAS, (("c.timestamp", "f.input"),), ["f.value"]),
        (SMAS, (), ["f.value"]),
        (SMAS, WIRES, []),
        (SMAS, WIRES, ["f.value", "f.value"]),
        (SMAS, WIRES, ["f.wrong"]),
        ((Node("f", "indicator.sma"),), (("c.close", "f.input"),), ["f.value"]),
        (SMAS, (("c.close", "f"),), ["f.value"]),
    ],
)
def test_studies_refused(spark, kinds, edges, outputs):
    with pytest.raises(StudyError):
        sample(spark, [1, 2, 3], kinds, edges, outputs)


@pytest.mark.parametrize("text", ["", "noport", ".port", "node.", "a.b.c"])
def test_ports_refused(text):
    with pytest.raises(StudyError):
        study.split_port(text)


def test_study_json_and_user_kind(spark):
    made = Study("s", (Node("c", study.SOURCE, {"limit": 9}), Node("d", "user.twice")), (("c.close", "d.input"),))
    assert Study.from_json(made.to_json()) == made
    assert made.with_window(limit=5).nodes[0].params == {"limit": 5}
    study.register_columns("user.twice", {"input": "double"}, {"value": "double"}, lambda i, p: {"value": i["input"] * 2})
    try:
        got = study.run_study(made, study.warehouse_source(closes(spark, [1.0, 2.0])), ["d.value"])
        assert column(got, "d.value") == [2.0, 4.0]
    finally:
        del study.KINDS["user.twice"]
    assert study.node_kinds(spark).select("kind").distinct().count() == 12


def test_display(spark):
    bars = closes(spark, [1.0, None, 3.0, 4.0, 5.0])
    assert display.complete(bars).count() == 4
    assert display.complete(bars, with_volume=False).select(F.sum("volume")).first()[0] == 0.0
    assert column(display.trim_warmup(bars, 3), "timestamp") == [2 * MIN, 3 * MIN, 4 * MIN]
    page = windows.page(bars, 4 * MIN, 2)
    assert column(page, "timestamp") == [2 * MIN, 3 * MIN] and page.first()["has_more"]
    assert display.has_values(bars, "close").first()["has_values"]
    assert display.timed(bars.withColumn("timestamp", F.lit(None).cast("long"))).count() == 0


def test_align_by_position_wants_equal_lengths(spark):
    a, b = closes(spark, [1.0, 2.0]), closes(spark, [3.0])
    with pytest.raises(StudyError):
        study.align_sources(a, b, by="position")
    assert study.align_sources(a, a, by="position").count() == 2


def test_stream_upsert_merges_a_minute_split_over_batches(spark, tmp_path):
    at = 1717804800000
    # (ms, id, price): the middle minute comes in three files, and not in the order of time
    files = [
        [(at + 1000, 1, 5.0), (at + MIN + 20_000, 3, 9.0)],
        [(at + MIN + 1000, 2, 7.0), (at + MIN + 40_000, 4, 2.0)],
        [(at + MIN + 50_000, 5, 8.0), (at + 2 * MIN, 6, 4.0)],
    ]
    kind = "ts timestamp, id long, price double, sym string"
    for n, rows in enumerate(files):
        df = spark.createDataFrame(rows, "ms long, id long, price double").select(F.timestamp_millis("ms").alias("ts"), "id", "price", F.lit("A").alias("sym"))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    store, mark = cs.scratch(spark), f"{tmp_path}/mark"
    cs.write(cs.in_memory(spark, [("x", "spot", "A", "1min", at, 0.0, 0.0, 0.0, 0.0, 0.0), ("x", "spot", "A", "1min", at - MIN, 1.0, 1.0, 1.0, 1.0, 1.0)]), store)
    want = {at - MIN: (1.0, 1.0, 1.0, 1.0, 1.0), at: (5.0, 5.0, 5.0, 5.0, 1.0), at + MIN: (7.0, 9.0, 2.0, 8.0, 4.0), at + 2 * MIN: (4.0, 4.0, 4.0, 4.0, 1.0)}

    def run():
        ticks = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        streams.upsert_stream(ticks, store, mark, "sym", "ts", "price", "id", "1 hour").awaitTermination()
        return {r["timestamp"]: tuple(r[p] for p in cs.PRICES) for r in cs.scan(spark, store).collect()}

    assert run() == want
    commits = sorted(p.name for p in (tmp_path / "mark/commits").iterdir() if p.name.isdigit())
    assert len(commits) in (3, 4)  # a last batch without rows may move the watermark
    for name in (commits[-1], f".{commits[-1]}.crc"):  # as if the run had ended before the last commit: the batch runs again
        (tmp_path / "mark/commits" / name).unlink()
    assert run() == want
