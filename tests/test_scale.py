"""Plans and operators that must hold for one very long series, a large store and a stream that never ends."""

import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright import queries
from barwright.functions import logic
from barwright.operators import catalog, chunks, display, indicators, windows
from barwright.plans import audit, study
from barwright.plans.study import Node, Param, Study, StudyError
from barwright.sources import candles as cs
from barwright.sources import folders
from barwright.streaming import bars as streams
from test_bars import KEY, MIN, column, near, ramp


def plan(df, final=False):
    if final:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def uneven(spark):
    """Two series of bars with gaps of a minute to ten days, nulls and NaNs."""
    rnd, rows = random.Random(5), []
    for symbol, n in (("A", 900), ("B", 37)):
        t = 0
        for i in range(n):
            t += rnd.choice([MIN] * 30 + [cs.DAY_MS // 3, 10 * cs.DAY_MS])
            x = rnd.choice([None, float("nan")]) if rnd.random() < 0.02 else rnd.gauss(100, 5)
            rows.append(("x", "spot", symbol, "1min", t, x, x, x, x, 1.0))
    return cs.in_memory(spark, rows).repartition(3).cache()


@pytest.mark.parametrize("rows", [1, 7, 64, 16_384])
@pytest.mark.parametrize("period", [1, 2, 5, 50])
def test_means_by_chunks_equal_means_by_series(uneven, period, rows):
    want = uneven.withColumn("m", indicators.sma(F.col("close"), period))
    got = indicators.with_sma(uneven, "close", period, "m", rows)
    key = lambda r: (r["symbol"], r["timestamp"])
    a, b = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert [key(r) for r in a] == [key(r) for r in b] and got.columns == want.columns
    assert near([r["m"] for r in a], [r["m"] for r in b])


@pytest.mark.parametrize("rows", [1, 16, 16_384])
def test_crosses_by_chunks_equal_crosses_by_series(uneven, rows):
    def crossed(w):
        return {"over": logic.crossover(F.col("f"), F.col("s"), w), "under": logic.crossunder(F.col("f"), F.col("s"), w)}

    means = lambda df, w: df.withColumns({"f": indicators.sma(F.col("close"), 2, w), "s": indicators.sma(F.col("close"), 5, w)})
    want = means(uneven, indicators.in_series()).withColumns(crossed(indicators.in_series()))
    got = chunks.along(uneven, 5, lambda cut: means(cut, chunks.in_chunk()).withColumns(crossed(chunks.in_chunk())), rows)
    signals = lambda df: sorted((r["symbol"], r["timestamp"], str(r["over"]), str(r["under"])) for r in df.collect())
    assert signals(got) == signals(want) and got.where("over").count() > 5


def test_no_window_over_a_series_holds_bars(uneven):
    got = plan(indicators.with_sma(uneven, "close", 20, "m"))
    by = [line.split("windowspecdefinition(")[1] for line in got.splitlines() if "Window [" in line]
    assert len(by) == 2 and sum("_chunk" in b for b in by) == 1
    assert all("timestamp" not in b.split(")")[0] for b in by if "_chunk" not in b)  # the other counts days


@pytest.mark.parametrize("n", [0, 1, 5, 36, 37, 100, 5000])
def test_last_rows_equal_brute_force(uneven, n):
    held = {}
    for r in uneven.collect():
        held.setdefault(r["symbol"], []).append(r["timestamp"])
    want = sorted((s, t) for s, ts in held.items() for t in sorted(ts)[max(0, len(ts) - n) :])
    assert sorted((r["symbol"], r["timestamp"]) for r in chunks.last_rows(uneven, n).collect()) == want
    each = uneven.withColumn("most", F.when(F.col("symbol") == "A", n).otherwise(F.lit(None)))
    assert chunks.last_rows(each, "most").where("symbol = 'B'").count() == 37 and chunks.last_rows(each, "most").columns == each.columns


def test_chunks_of_nothing_and_of_bars_without_a_time(spark):
    none = cs.in_memory(spark, [])
    assert indicators.with_sma(none, "close", 3, "m").collect() == [] == chunks.last_rows(none, 3).collect()
    odd = cs.in_memory(spark, [(*KEY, None, 1.0, 1.0, 1.0, 1.0, 1.0), (None, *KEY[1:], 5, 2.0, 2.0, 2.0, 2.0, 2.0), *ramp(3, 0)])
    assert indicators.with_sma(odd, "close", 2, "m").count() == 5 and chunks.last_rows(odd, 1).count() == 2


@pytest.fixture(scope="module")
def store(spark):
    """Two series: one of five days, one of two days a year later."""
    path = cs.scratch(spark)
    days = [k * cs.DAY_MS for k in range(5)]
    far = [365 * cs.DAY_MS + k * cs.DAY_MS for k in range(2)]
    cs.write(cs.in_memory(spark, [r for d in days for r in ramp(100, d)] + [r for d in far for r in ramp(50, d, "ETHUSDT")]), path)
    return path


def test_catalog_of_a_store_reads_footers_only(spark, store):
    got = catalog.of_store(spark, store)
    assert "PushedAggregation: [MIN(timestamp), MAX(timestamp), COUNT(*)]" in plan(got)
    want = catalog.snapshot(cs.scan(spark, store))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    assert catalog.of_store(spark, store, cs.dataset_bytes(spark, store)).where("approx_size_bytes > 0").count() == 2


def files_read(df):
    """Partition folders that a query's scans have read."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("Scan parquet"):
            total += node.metrics().apply("numPartitions").value() if node.metrics().contains("numPartitions") else 0
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return total, text


def test_requests_read_only_their_own_days(spark, store):
    kind = "exchange string, category string, symbol string, interval string, start long, end long, limit long"
    far = 365 * cs.DAY_MS
    requests = spark.createDataFrame([(*KEY, cs.DAY_MS, cs.DAY_MS + 9 * MIN, None), ("bybit", "spot", "ETHUSDT", "1min", far, far + 4 * MIN, None), ("bybit", "spot", "NONE", "1min", 0, far, None)], kind)
    got = windows.load_stored(spark, store, requests, catalog.of_store(spark, store))
    assert got.count() == 15
    read, text = files_read(got)
    assert "dynamicpruning" in text.lower()
    assert read == 2


def test_last_candles_read_only_the_days_that_hold_them(spark, store):
    got = windows.latest_stored(spark, store, 120)
    assert sorted((r["symbol"], r["n"]) for r in got.groupBy("symbol").agg(F.count("*").alias("n")).collect()) == [("BTCUSDT", 120), ("ETHUSDT", 100)]
    assert column(got.where("symbol = 'BTCUSDT'"), "timestamp") == [3 * cs.DAY_MS + i * MIN for i in range(80, 100)] + [4 * cs.DAY_MS + i * MIN for i in range(100)]
    assert files_read(got)[0] == 4  # two days of each
    assert windows.latest_stored(spark, store, 0).collect() == []


def test_study_of_a_store_reads_prices_once(spark, store):
    mean = lambda **window: Study("s", (Node("c", study.SOURCE, window), Node("m", "indicator.sma", {"period": 5})), (("c.close", "m.input"),))
    got = study.run_study(mean(start_ms=0, end_ms=1 << 50), study.stored_source(spark, store), ["m.value"])
    scans = [line.split("ReadSchema: ")[1] for line in plan(got).splitlines() if "Scan parquet" in line]
    assert sorted(scans) == ["struct<timestamp:bigint,close:double>", "struct<timestamp:bigint>"]  # the times are counted by day
    for window, n in (({"start_ms": 0, "end_ms": 1 << 50}, 600), ({"limit": 60}, 110)):  # a window of 110 minutes has 50 bars of the second series
        got = study.run_study(mean(**window), study.stored_source(spark, store), ["m.value"])
        want = study.run_study(mean(**window), study.warehouse_source(cs.scan(spark, store)), ["m.value"])
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and got.count() == n


def test_what_is_not_stored_is_a_stated_error(spark, store):
    keys = dict(zip(cs.KEYS, KEY))
    assert cs.scan(spark, store, keys, 0, 9 * MIN).count() == 10
    none = cs.scan(spark, store, keys, 300 * cs.DAY_MS, 301 * cs.DAY_MS)
    assert none.count() == 0 and none.columns == [*cs.KEYS, "timestamp", *cs.PRICES]
    for call in (
        lambda: cs.scan(spark, f"{store}-gone"),
        lambda: cs.scan(spark, store, keys | {"symbol": "NONE"}),
        lambda: catalog.of_store(spark, f"{store}-gone"),
        lambda: windows.latest_stored(spark, f"{store}-gone", 3),
        lambda: cs.upsert(spark, f"{store}-gone", cs.in_memory(spark, ramp(1, 0))),
    ):
        with pytest.raises(cs.NoStore, match="nothing is stored at"):
            call()


def test_upsert_reads_two_days_of_series_years_apart(spark, store):
    fresh = cs.in_memory(spark, ramp(1, 0) + ramp(1, 365 * cs.DAY_MS, "ETHUSDT"))
    days = fresh.select(*cs.KEYS, cs.day_of(F.col("timestamp")).alias("day"))
    with folders.scratch(spark) as at:
        days.write.parquet(at)
        low, high = days.agg(F.min("day"), F.max("day")).first()
        held = cs.partitions(spark, store, spark.read.schema(days.schema).parquet(at), low, high)
        read, _ = files_read(held)
        assert held.count() == 150 and read == 2


def test_upsert_that_is_cut_short(spark, monkeypatch):
    path = cs.scratch(spark)
    cs.write(cs.in_memory(spark, ramp(5, 0) + ramp(5, cs.DAY_MS)), path)
    fresh = cs.in_memory(spark, [(*KEY, t, 7.0, 7.0, 7.0, 7.0, 7.0) for t in (0, cs.DAY_MS, 2 * cs.DAY_MS)])
    sevens = lambda: cs.scan(spark, path).where("close = 7").count()

    class Killed(BaseException):
        pass

    def killed(*_):
        raise Killed

    monkeypatch.setattr(folders, "swap", killed)  # all is staged, nothing is ready
    with pytest.raises(Killed):
        cs.upsert(spark, path, fresh)
    assert cs.scan(spark, path).count() == 10 and sevens() == 0
    monkeypatch.undo()
    move = folders._move
    monkeypatch.setattr(folders, "_move", killed)  # ready, but not moved
    with pytest.raises(Killed):
        cs.upsert(spark, path, fresh)
    assert sevens() == 0
    monkeypatch.setattr(folders, "_move", move)
    folders.recover(spark, path, 5)
    assert cs.scan(spark, path).count() == 11 and sevens() == 3
    fs, at = folders._fs(spark, path)
    assert not [c for c in folders._children(fs, at) if "=" not in c.getName() and c.getName() != "_SUCCESS"]
    cs.upsert(spark, path, fresh)
    assert cs.scan(spark, path).count() == 11 and sevens() == 3
    with pytest.raises(ValueError, match="1 rows"):
        cs.upsert(spark, path, cs.in_memory(spark, [(*KEY, None, 1.0, 1.0, 1.0, 1.0, 1.0)]))
    cs.upsert(spark, path, fresh.limit(0))
    assert cs.scan(spark, path).count() == 11


def test_upsert_leaves_nothing_in_the_scratch_folder(spark):
    fs, at = folders._fs(spark, folders.scratch_root(spark))
    path = cs.scratch(spark)
    cs.write(cs.in_memory(spark, ramp(5, 0)), path)
    before = len(folders._children(fs, at))
    cs.incremental(spark, path, cs.in_memory(spark, ramp(9, 2 * MIN)))
    assert len(folders._children(fs, at)) == before and cs.scan(spark, path).count() == 11


def test_scratch_needs_a_shared_folder_on_a_cluster():
    values = {"spark.sql.warehouse.dir": "/w/"}
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda name, *default: values.get(name, *default)), sparkContext=SimpleNamespace(master=master))
    assert folders.scratch_root(session("local[4]")) == "/w"
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            folders.scratch_root(session(master))


def test_stream_drops_ticks_sent_again_and_its_state_is_bounded(spark, tmp_path):
    at, files = 1717804800000, 40
    for n in range(files):  # each file: an hour's ticks, and those of the file before again
        rows = [(at + k * 3_600_000 + i * 20_000, k * 10 + i, float(i)) for k in (n - 1, n) if k >= 0 for i in range(6)]
        df = spark.createDataFrame(rows, "ms long, id long, price double").select(F.timestamp_millis("ms").alias("ts"), "id", "price", F.lit("A").alias("sym"))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{n:03d}")
    store = cs.scratch(spark)
    cs.write(cs.in_memory(spark, ramp(1, 0)), store)
    ticks = spark.readStream.schema("ts timestamp, id long, price double, sym string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run = streams.upsert_stream(ticks, store, f"{tmp_path}/mark", "sym", "ts", "price", "id", "2 hours")
    run.awaitTermination()
    got = cs.scan(spark, store).where("symbol = 'A'")
    assert got.count() == 2 * files and got.agg(F.sum("volume")).first()[0] == 6 * files
    kept = [[o["numRowsTotal"] for o in p["stateOperators"]] for p in run.recentProgress if p["numInputRows"]]
    assert len(kept) == files and max(max(k) for k in kept[5:]) <= 40
    assert sorted(p.name for p in (tmp_path / "mark").iterdir() if not p.name.startswith(".")) == ["commits", "metadata", "offsets", "sources", "state"]


def test_stream_state_has_partitions_by_cores(spark, tmp_path):
    spark.range(20).select(F.timestamp_millis(F.lit(1717804800000) + F.col("id") * 20_000).alias("ts"), "id", F.lit(1.0).alias("price"), F.lit("A").alias("sym")).write.parquet(f"{tmp_path}/in/0")
    store = cs.scratch(spark)
    cs.write(cs.in_memory(spark, ramp(1, 0)), store)
    ticks = spark.readStream.schema("ts timestamp, id long, price double, sym string").parquet(f"{tmp_path}/in/*")
    used = lambda run: {o["numShufflePartitions"] for p in run.recentProgress for o in p["stateOperators"]}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    try:
        run = streams.upsert_stream(ticks, store, f"{tmp_path}/a", "sym", "ts", "price", "id", "1 hour")
        run.awaitTermination()
        assert used(run) == {2 * spark.sparkContext.defaultParallelism} and spark.conf.get("spark.sql.shuffle.partitions") == "48"
        bars = streams.stream_bars(ticks, "sym", "ts", "price", "id", "1m", "1 minute")
        run = streams.write_bars(bars, f"{tmp_path}/out", f"{tmp_path}/b", parts=3)
        run.awaitTermination()
        assert used(run) == {3}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert cs.scan(spark, store).where("symbol = 'A'").agg(F.sum("volume")).first()[0] == 20


# studies


@pytest.mark.parametrize("rows", [3, 16_384])
def test_study_chunks_match_one_table(uneven, rows):
    n = Node
    nodes = (
        n("c", study.SOURCE, {"start_ms": 0, "end_ms": 1 << 50}),
        n("f", "indicator.sma", {"period": 3}),
        n("e", "indicator.ema", {"period": 4}),
        n("s", "indicator.sma", {"period": 6}),
        n("x", "logic.crossover"),
        n("l", "literal.number", {"value": "100"}),
        n("g", "logic.gt"),
        n("b", "logic.and"),
    )
    edges = (("c.close", "f.input"), ("f.value", "e.input"), ("e.value", "s.input"), ("f.value", "x.fast"), ("s.value", "x.slow"), ("c.timestamp", "l.reference"), ("s.value", "g.left"), ("l.value", "g.right"), ("x.signal", "b.left"), ("g.signal", "b.right"))
    ports = ["f.value", "e.value", "s.value", "x.signal", "b.signal"]
    got = study.run_study(Study("s", nodes, edges), study.warehouse_source(uneven), ports, rows)
    series = indicators.in_series()
    want = uneven.withColumn("f", indicators.sma(F.col("close"), 3))
    want = indicators.ema(want, "f", 4, "e").withColumn("s", indicators.sma(F.col("e"), 6)).withColumn("x", logic.crossover(F.col("f"), F.col("s"), series))
    want = want.withColumn("b", logic.and_(F.col("x"), logic.gt(F.col("s"), F.lit(100.0))))
    show = lambda df, cols: sorted((r["symbol"], r["timestamp"], *(None if r[c] is None else round(float(r[c]), 6) for c in cols)) for r in df.collect())
    assert show(got, ports) == show(want, ["f", "e", "s", "x", "b"]) and got.where("`b.signal`").count() > 3


@pytest.mark.parametrize("rows", [5, 16_384])
def test_grouped_kind_sees_a_chunk_and_its_halo(spark, uneven, rows):
    """A median of the last bars, which is no column expression of the library."""
    def median(bars: pd.DataFrame, values: dict) -> pd.DataFrame:
        return pd.DataFrame({"value": bars["input"].rolling(values["period"]).median(), "bars": len(bars)})

    period = Param("period", "integer", default=7, least=1, required=True)
    study.register_grouped("user.median", {"input": "double"}, {"value": "double", "bars": "bigint"}, median, (period,), lambda values: values["period"] - 1)
    try:
        made = Study("s", (Node("c", study.SOURCE, {"start_ms": 0, "end_ms": 1 << 50}), Node("m", "user.median", {"period": "7"}), Node("f", "indicator.sma", {"period": 2})), (("c.volume", "m.input"), ("m.value", "f.input")))
        got = study.run_study(made, study.warehouse_source(uneven.withColumn("volume", F.col("timestamp") / 1000.0)), ["m.value", "m.bars", "f.value"], rows)
        frame = uneven.select("symbol", (F.col("timestamp") / 1000.0).alias("v"), "timestamp").toPandas().sort_values(["symbol", "timestamp"])
        want = frame.groupby("symbol")["v"].rolling(7).median().to_numpy()
        have = got.select("symbol", "timestamp", F.col("`m.value`").alias("m"), F.col("`m.bars`").alias("bars"), F.col("`f.value`").alias("f")).toPandas().sort_values(["symbol", "timestamp"])
        assert len(have) == len(frame) and pd.Series(want).round(6).equals(have["m"].reset_index(drop=True).round(6))
        assert rows > 5 or have["bars"].max() < 200
        kinds, params = study.node_kinds(spark), study.kind_params(spark)
        assert kinds.where("kind = 'user.median'").count() == 3 and params.where("kind = 'user.median' AND required").count() == 1
        with pytest.raises(StudyError, match="missing"):
            study.run_study(Study("s", (made.nodes[0], Node("m", "user.median")), (made.edges[0],)), study.warehouse_source(uneven), ["m.value"])
    finally:
        del study.KINDS["user.median"]


@pytest.mark.parametrize(
    "param, given, want",
    [
        (Param("p", "integer", least=1), 5, 5),
        (Param("p", "integer", least=1), " 5 ", 5),
        (Param("p", "integer"), "5.0", None),
        (Param("p", "integer"), True, None),
        (Param("p", "integer", least=1), 0, None),
        (Param("p", "integer", most=9), 10, None),
        (Param("p", "integer", default=3), None, 3),
        (Param("p", "integer", default=3, required=True), None, None),
        (Param("p", "number"), "1e3", 1000.0),
        (Param("p", "number"), 30, 30.0),
        (Param("p", "number"), "nan", None),
        (Param("p", "number"), "x", None),
        (Param("p", "boolean"), "false", False),
        (Param("p", "boolean"), True, True),
        (Param("p", "boolean"), 1, None),
        (Param("p", "string"), "x", "x"),
        (Param("p", "string"), 1, None),
    ],
)
def test_parameters_are_read_by_type_and_bounds(param, given, want):
    if want is None:
        with pytest.raises(StudyError):
            param.read({"p": given})
    else:
        got = param.read({"p": given})
        assert got == want and type(got) is type(want)


def test_display_trims_by_days(uneven):
    assert display.trim_warmup(uneven, 3).groupBy("symbol").count().where("count = 3").count() == 2


def test_audit_is_one_pass(spark):
    got = audit.audit(queries.specs(spark, "/root/testdata/sf0.001"), study.node_kinds(spark))
    assert plan(got).count("Scan parquet") == 1 and "Exchange" not in plan(got) and "Join" not in plan(got)


def test_audit_of_odd_studies(spark):
    kind = "id long, nodes array<struct<id: string, kind: string, params: map<string, string>>>, edges array<struct<from: string, to: string>>"
    sma = lambda i, p="3": (i, "indicator.sma", {"period": p})
    rows = [
        (1, None, None),
        (2, [], [("a.b", "c.d")]),
        (3, [sma("f"), sma("f"), sma("f", None)], [(None, "f.input"), ("f.value", "f.input"), ("f.value", "f.input")]),
        (4, [(None, None, None), ("c", "datasource.candles", None)], [("c.close", "c.close")]),
        (5, [sma("a"), sma("b"), sma("d")], [("a.value", "b.input"), ("b.value", "d.input"), ("d.value", "a.input")]),
    ]
    got = {}
    for r in audit.audit(spark.createDataFrame(rows, kind), study.node_kinds(spark)).collect():
        got.setdefault(r["id"], set()).add((r["fault"], r["detail"]))
    assert 1 not in got and got[2] == {("unknown_node", "a.b"), ("unknown_node", "c.d")}
    assert got[3] == {("duplicate_node", "f"), ("bad_port", None), ("double_wire", "f.input"), ("bad_period", "f"), ("cycle", "")}
    assert got[4] == {("unknown_kind", None), ("unknown_port", "c.close"), ("cycle", "")}
    assert got[5] == {("cycle", "")}
    assert audit.audit(spark.createDataFrame(rows, kind), study.node_kinds(spark).limit(0)).where("fault = 'unknown_kind'").count() == 6
    assert audit.bad_params(spark.createDataFrame(rows, kind).drop("edges"), study.kind_params(spark)).collect() == [(3, "f", "period", "missing")]
