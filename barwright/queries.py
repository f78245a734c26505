"""Queries over the given tables: candles are made of events (5 symbols) and of orders (for long intervals)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions import interval as iv
from barwright.functions import logic, names
from barwright.operators import catalog, display, indicators, runlog, windows
from barwright.operators.chunks import along, in_chunk, last_rows
from barwright.operators.dedup import keep_one, merge
from barwright.operators.resample import resample
from barwright.plans import audit, study
from barwright.sources import candles as cs
from barwright.sources.candles import KEYS, PRICES
from barwright.streaming import bars as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: A range within the events' days, for range queries: 2024-01-05 06:30 to 2024-01-09 18:45 UTC.
START, END = 1704436200000, 1704825900000
SERIES = ["exchange", "category", "symbol"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1-minute candles of events: symbol is the event type."""
    return cs.candles_from_ticks(events(spark, sf_dir), "event_type", "ts", "value", "event_id")


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(minutes(spark, sf_dir), "1h")


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1-minute candles of orders: symbol is the priority, price the total."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return cs.candles_from_ticks(orders, "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey")


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def bars_out(df: DataFrame) -> DataFrame:
    return rounded(df.select(*KEYS, "timestamp", *PRICES), *PRICES)


def stored(spark: SparkSession, candles: DataFrame) -> str:
    path = cs.scratch(spark)
    cs.write(candles, path)
    return path


# sources and sinks


@query
def candles_all(spark, sf_dir):
    return bars_out(minutes(spark, sf_dir))


@query
def candles_range(spark, sf_dir):
    path = stored(spark, minutes(spark, sf_dir))
    return bars_out(last_rows(cs.scan(spark, path, {"symbol": "click"}, START, END), 500))


@query
def write_roundtrip(spark, sf_dir):
    return bars_out(cs.scan(spark, stored(spark, minutes(spark, sf_dir))))


@query
def candles_resampled(spark, sf_dir):
    held = cs.scan(spark, stored(spark, minutes(spark, sf_dir)), None, START, END)
    return bars_out(last_rows(resample(held, "4h"), 10))


@query
def candles_latest(spark, sf_dir):
    """The latest hourly bars of every series of a store, whose footers give series and bounds."""
    path = stored(spark, minutes(spark, sf_dir))
    bounds = catalog.of_store(spark, path)
    wanted = {"start": F.lit(None).cast("long"), "end": F.lit(None).cast("long"), "limit": F.lit(24).cast("long")}
    return bars_out(windows.load_stored(spark, path, bounds.select(*KEYS).withColumns(wanted), bounds, "1h"))


@query
def candles_last(spark, sf_dir):
    """The last 700 candles of every stored series; only the days that hold them are read."""
    return bars_out(windows.latest_stored(spark, stored(spark, minutes(spark, sf_dir)), 700))


@query
def load_many_requests(spark, sf_dir):
    """Four requests for every stored series: a range, the same again, the latest bars, and bars from a start on."""
    path = stored(spark, minutes(spark, sf_dir))
    bounds = catalog.of_store(spark, path)
    kinds = F.array(*(F.struct(F.lit(k).alias("request"), *(F.lit(v).cast("long").alias(c) for c, v in zip(("start", "end", "limit"), w))) for k, w in enumerate([(START, END, None), (START, END, None), (None, None, 24), (START, None, 10)])))
    requests = bounds.select(*KEYS, F.inline(kinds))
    got = windows.load_stored(spark, path, requests, bounds, "1h", "request")
    return rounded(got.select("request", *KEYS, "timestamp", *PRICES), *PRICES)


@query
def incremental_upsert(spark, sf_dir):
    """Half of a month is stored; then what came after a middle day is upserted, with closes raised by one."""
    held = minutes(spark, sf_dir)
    path = stored(spark, held.where(F.col("timestamp") <= END))
    cs.incremental(spark, path, held.where(F.col("timestamp") >= START).withColumn("close", F.col("close") + 1))
    return bars_out(cs.scan(spark, path))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_of(minutes(spark, sf_dir))


def pages_of(bars: DataFrame) -> DataFrame:
    """Landed exchange pages: JSON of each day's candles of a symbol; every eleventh close isn't a number, and one day in seven has failed."""
    bars = bars.withColumn("day", F.floor(F.col("timestamp") / cs.DAY_MS))
    text = lambda c: F.col(c).cast("string")
    close = F.when(F.pmod(F.floor(F.col("timestamp") / 60_000), F.lit(11)) == 0, F.lit("n/a")).otherwise(text("close"))
    item = F.array(text("timestamp"), text("open"), text("high"), text("low"), close, text("volume"), F.lit("0"))
    day = bars.groupBy("symbol", "day").agg(F.collect_list(item).alias("list"))  # a page: one day of one symbol
    code = F.when(F.pmod("day", F.lit(7)) == 0, 10001).otherwise(0)
    return day.select(F.to_json(F.struct(code.alias("retCode"), F.lit("OK").alias("retMsg"), F.struct("symbol", F.lit("spot").alias("category"), "list").alias("result"))).alias("body"))


@query
def kline_decode(spark, sf_dir):
    good, _ = cs.decode_pages(pages(spark, sf_dir))
    return rounded(good.select("symbol", names.product_class(F.col("product_class")).alias("product_class"), "timestamp", *PRICES), *PRICES)


@query
def kline_rejects(spark, sf_dir):
    _, bad = cs.decode_pages(pages(spark, sf_dir))
    return bad.agg(F.count("*").alias("rejects"), F.count_if(F.col("bad").startswith("{")).alias("failed_pages"))


@query
def kline_history(spark, sf_dir):
    """Landed pages, decoded; pages of a day's second half came again with other closes, and the first arrival stays."""
    held = minutes(spark, sf_dir)
    again = held.where(F.pmod("timestamp", F.lit(cs.DAY_MS)) >= cs.DAY_MS // 2).withColumn("close", F.col("close") + 5)
    landed = pages_of(held).withColumn("arrival", F.lit(0)).union(pages_of(again).withColumn("arrival", F.lit(1)))
    return bars_out(cs.history(landed, "x", "spot"))


@query
def fetch_plan(spark, sf_dir):
    spans = catalog.time_bounds(minutes(spark, sf_dir)).withColumnsRenamed({"from": "start", "to": "end"})
    return cs.fetch_plan(spans).select("symbol", names.interval_code(F.lit("1min")).alias("code"), F.col("low").alias("page_start"), F.col("high").alias("page_end"))


@query
def partition_columns(spark, sf_dir):
    day = cs.day_of(F.col("timestamp"))
    parts = minutes(spark, sf_dir).select("symbol", *(f(day).alias(n) for n, f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth))))
    return parts.groupBy("symbol", "year", "month", "day").agg(F.count("*").alias("bars"))


# aggregates and catalog


def _resampled(name: str, base: Callable, interval: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return bars_out(resample(base(spark, sf_dir), interval))

    QUERIES[name] = run


for _name, _base, _interval in (("5m", minutes, "5m"), ("1h", minutes, "1h"), ("1d", minutes, "1d"), ("1w", order_bars, "1w"), ("1mo", order_bars, "1mo"), ("1y", order_bars, "1y")):
    _resampled(f"resample_{_name}", _base, _interval)


@query
def time_bounds(spark, sf_dir):
    return catalog.time_bounds(minutes(spark, sf_dir)).select("symbol", F.col("from").alias("from_ts"), F.col("to").alias("to_ts"))


@query
def last_timestamp(spark, sf_dir):
    return catalog.last_timestamp(minutes(spark, sf_dir)).select("symbol", "last_ts")


def both_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog of the candles of events and of orders."""
    return catalog.snapshot(minutes(spark, sf_dir).union(order_bars(spark, sf_dir)))


def catalog_out(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, F.col("from").alias("from_ts"), F.col("to").alias("to_ts"), "record_count")


@query
def catalog_snapshot(spark, sf_dir):
    return catalog_out(both_markets(spark, sf_dir))


@query
def catalog_bytes(spark, sf_dir):
    """The catalog of a store, saved and loaded, with bytes and the time of the last write."""
    path, at = stored(spark, minutes(spark, sf_dir).union(order_bars(spark, sf_dir))), cs.scratch(spark)
    catalog.save(catalog.of_store(spark, path, cs.dataset_bytes(spark, path)), at)
    held = catalog.load(spark, at)
    return held.select(*KEYS, "record_count", (F.col("approx_size_bytes") > 0).alias("has_bytes"), (F.col("last_updated") <= F.col("generated_at")).alias("written_before"), F.col("version").cast("long").alias("version"))


@query
def catalog_store(spark, sf_dir):
    """Bounds and counts of a store's series, read from its files' footers."""
    return catalog_out(catalog.of_store(spark, stored(spark, minutes(spark, sf_dir).union(order_bars(spark, sf_dir)))))


@query
def catalog_totals(spark, sf_dir):
    return catalog.totals(both_markets(spark, sf_dir))


@query
def catalog_search(spark, sf_dir):
    return catalog_out(catalog.search(both_markets(spark, sf_dir), "  IC "))


@query
def catalog_lookup(spark, sf_dir):
    """The catalog knows the events' series only, as of a range that has passed; bounds of the others come from their candles."""
    both = minutes(spark, sf_dir).union(order_bars(spark, sf_dir))
    found = catalog.lookup(both.select(*KEYS).distinct(), catalog.snapshot(cs.time_filter(minutes(spark, sf_dir), START, END)), both)
    return found.select("symbol", F.col("from").alias("from_ts"), F.col("to").alias("to_ts"))


@query
def market_symbols(spark, sf_dir):
    return catalog.market_symbols(both_markets(spark, sf_dir), "x", "spot")


@query
def missing_symbols(spark, sf_dir):
    offered = minutes(spark, sf_dir).union(order_bars(spark, sf_dir)).select("symbol").distinct()
    return catalog.missing_symbols(offered, catalog.snapshot(minutes(spark, sf_dir)))


@query
def selected_symbols(spark, sf_dir):
    chosen = events(spark, sf_dir).select(F.col("event_type").alias("symbol")).distinct().union(order_bars(spark, sf_dir).select("symbol").distinct())
    offered = minutes(spark, sf_dir).union(order_bars(spark, sf_dir)).where(F.col("symbol").contains("i"))
    return catalog.selected_symbols(chosen, offered)


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars, in which the close of every fifth hour and the volume of every seventh are null."""
    hour = F.floor(F.col("timestamp") / 3_600_000)
    hole = lambda c, n: F.when(F.pmod(hour, F.lit(n)) != 0, F.col(c))
    return hours(spark, sf_dir).withColumns({"close": hole("close", 5), "volume": hole("volume", 7)})


@query
def null_audit(spark, sf_dir):
    return catalog.null_counts(gappy(spark, sf_dir))


@query
def bar_duration(spark, sf_dir):
    return catalog.bar_duration(minutes(spark, sf_dir)).select("symbol", "bar_ms")


@query
def dedup_keep_last(spark, sf_dir):
    """One tick a symbol and hour: the last arrival."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    ticks = events(spark, sf_dir).select("event_type", (ms - F.pmod(ms, F.lit(3_600_000))).alias("hour"), "event_id", "value")
    return rounded(keep_one(ticks, ["event_type", "hour"], "event_id"), "value")


@query
def merge_candles(spark, sf_dir):
    held = hours(spark, sf_dir)
    fresh = held.where(F.col("timestamp") >= START).withColumns({"timestamp": F.col("timestamp") + 43_200_000, "close": F.col("close") * 2})
    return bars_out(merge(held, fresh, [*KEYS, "timestamp"]))


# indicators and signals


def indicated(df: DataFrame, name: str) -> DataFrame:
    return rounded(df.select("symbol", "timestamp", name), name)


@query
def sma_20(spark, sf_dir):
    return indicated(indicators.with_sma(hours(spark, sf_dir), "close", 20, "sma"), "sma")


@query
def sma_nan(spark, sf_dir):
    """A mean and a comparison over closes of which every fifth hour's is no number."""
    gap = F.when(F.floor(F.col("timestamp") / 3_600_000) % 5 == 0, F.lit(float("nan"))).otherwise(F.col("close"))
    held = indicators.with_sma(hours(spark, sf_dir).withColumn("close", gap), "close", 3, "sma")
    return rounded(held.select("symbol", "timestamp", "sma", logic.gt(F.round("close", 6), F.round("sma", 6)).alias("signal")), "sma")


@query
def ema_20(spark, sf_dir):
    return indicated(indicators.ema(hours(spark, sf_dir), "close", 20, "ema"), "ema")


@query
def rsi_14(spark, sf_dir):
    return indicated(indicators.rsi(hours(spark, sf_dir), "close", 14, "rsi"), "rsi")


def crossing(spark: SparkSession, sf_dir: str, **signals: Column) -> DataFrame:
    """Hourly bars with a fast and a slow mean, and signals over them and the bar before."""
    means = lambda cut: cut.withColumns({n: F.round(indicators.sma(F.col("close"), p, in_chunk()), 6) for n, p in (("fast", 3), ("slow", 8))})
    return along(hours(spark, sf_dir), 8, lambda cut: means(cut).withColumns(signals))


def _signal(name: str, make: Callable[[], Column]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return crossing(spark, sf_dir, signal=make()).select("symbol", "timestamp", "signal")

    QUERIES[name] = run


for _name, _make in {
    "gt_sma": lambda: logic.gt(F.col("fast"), F.col("slow")),
    "lt_threshold": lambda: logic.lt(F.col("fast"), F.lit(50.0)),
    "and_strict": lambda: logic.and_(logic.gt(F.col("close"), F.lit(50.0)), logic.gt(F.col("fast"), F.col("slow"))),
    "or_strict": lambda: logic.or_(logic.gt(F.col("close"), F.lit(50.0)), logic.gt(F.col("fast"), F.col("slow"))),
    "crossover_sma": lambda: logic.crossover(F.col("fast"), F.col("slow"), in_chunk()),
    "crossunder_sma": lambda: logic.crossunder(F.col("fast"), F.col("slow"), in_chunk()),
}.items():
    _signal(_name, _make)


@query
def two_source_align(spark, sf_dir):
    held = hours(spark, sf_dir)
    return rounded(study.align_sources(held.where("symbol = 'click'"), held.where("symbol = 'view'")), "left_close", "right_close")


@query
def warmup_trim(spark, sf_dir):
    return indicated(display.trim_warmup(indicators.with_sma(hours(spark, sf_dir), "close", 20, "sma"), 50), "sma")


@query
def history_page(spark, sf_dir):
    return windows.page(hours(spark, sf_dir), END, 40, 20).select("symbol", "timestamp", "has_more")


# display


@query
def complete_candles(spark, sf_dir):
    return bars_out(display.complete(gappy(spark, sf_dir)))


@query
def signal_markers(spark, sf_dir):
    marked = crossing(spark, sf_dir, signal=logic.crossover(F.col("fast"), F.col("slow"), in_chunk()))
    return display.markers(marked, "signal").select("symbol", "time", "shape", "position")


@query
def valued_points(spark, sf_dir):
    return rounded(display.valued(gappy(spark, sf_dir), "close").select("symbol", "timestamp", "close"), "close")


@query
def align_line(spark, sf_dir):
    held = hours(spark, sf_dir)
    points = held.where(F.pmod(F.floor(F.col("timestamp") / 3_600_000), F.lit(3)) == 0).select(*KEYS, "timestamp", F.col("close").alias("value"))
    late = points.withColumns({"timestamp": F.col("timestamp") + 400, "value": F.col("value") + 1})
    return rounded(display.align(held, points.union(late), "value").select("symbol", "time", "value"), "value")


@query
def volume_bars(spark, sf_dir):
    return display.volume_bars(hours(spark, sf_dir)).select("symbol", "time", "volume", "is_up")


# scalar functions over rows


def interval_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = F.array(*map(F.lit, ("s", "M", "min", "Hours", "d", "week", "mo", "YEARS", "parsec", "", "hr", "WK", "yr", " Hours", "min ")))
    text = F.concat((F.col("event_id") % 100).cast("string"), F.get(units, (F.col("user_id") % 15).cast("int")))
    return events(spark, sf_dir).select("event_id", text.alias("text"))


@query
def interval_parse(spark, sf_dir):
    """Interval texts made of events: the id's last two digits and a unit by the user's id."""
    rows = interval_texts(spark, sf_dir)
    n, unit = iv.parsed(F.col("text"))
    return rows.select("event_id", "text", n.alias("n"), iv.printed(n, unit).alias("printed"))


@query
def interval_code(spark, sf_dir):
    return interval_texts(spark, sf_dir).select("event_id", "text", names.interval_code(F.col("text")).alias("code"))


@query
def resolve_window(spark, sf_dir):
    """A request for each event, of which start, end or limit may be missing, within the bounds of its symbol."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    k = F.col("event_id") % 8
    limit = F.when(k.isin(1, 3, 5, 7), F.col("event_id") % 600 + 1)
    requests = events(spark, sf_dir).select("event_id", F.col("event_type").alias("symbol"), F.when(k >= 4, ms).alias("start"), F.when(k.isin(2, 3, 6, 7), ms + (F.col("user_id") % 5 - 1) * 86_400_000).alias("end"), limit.alias("limit"))
    bounds = catalog.time_bounds(minutes(spark, sf_dir)).select("symbol", "from", "to")
    return windows.resolve(requests.join(bounds, "symbol"), "1h").select("event_id", "start_ms", "end_ms", "row_limit", F.col("error").isNotNull().alias("rejected"))


# run log


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each event: kind, market and status follow from its columns."""
    status = F.get(F.array(*map(F.lit, ("pending", "running", "completed", "failed"))), (F.col("event_id") % 4).cast("int"))
    kind = F.when(F.col("user_id") % 2 == 0, "ingest_candles").otherwise("refresh_catalog")
    return events(spark, sf_dir).select(F.col("event_id").alias("run_id"), kind.alias("kind"), F.lit("x").alias("exchange"), F.concat(F.lit("m"), (F.col("user_id") % 50).cast("string")).alias("category"), F.col("event_type").alias("symbol"), status.alias("status"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"))


@query
def runlog_recent(spark, sf_dir):
    return runlog.recent(runs(spark, sf_dir), "ingest_candles", "Completed, failed", limit=800).select("run_id", "status", "created_at")


@query
def runlog_summary(spark, sf_dir):
    return runlog.summary(runs(spark, sf_dir))


@query
def runlog_dedup(spark, sf_dir):
    held = runs(spark, sf_dir)
    cut = START
    return runlog.duplicates(held.where(F.col("created_at") >= cut), held.where((F.col("created_at") < cut) & (F.col("run_id") % 3 == 0))).select("run_id", "signature")


# streams


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # as a pattern, the path may be a file or a folder
    return spark.readStream.schema(events(spark, sf_dir).schema).parquet(f"{sf_dir}/events.parque[t]")


@query
def stream_resample(spark, sf_dir):
    out, at = cs.scratch(spark), cs.scratch(spark)
    bars = streams.stream_bars(_streamed(spark, sf_dir), "event_type", "ts", "value", "event_id", "1h", "10 minutes")
    streams.write_bars(bars, out, at).awaitTermination()
    return bars_out(spark.read.schema(cs.SCHEMA).parquet(out))


@query
def stream_upsert(spark, sf_dir):
    held = minutes(spark, sf_dir).where(F.col("timestamp") < START).withColumn("close", F.lit(0.0))
    store = stored(spark, held)
    streams.upsert_stream(_streamed(spark, sf_dir), store, cs.scratch(spark), "event_type", "ts", "value", "event_id", "60 days").awaitTermination()
    return bars_out(cs.scan(spark, store))


@query
def stream_upsert_two_batches(spark, sf_dir):
    """Ticks landed in two files, which split most minutes, and read as two micro-batches; every tenth tick of the first comes again in the second."""
    landed, store = cs.scratch(spark), stored(spark, minutes(spark, sf_dir).where(F.col("timestamp") < START).withColumn("close", F.lit(0.0)))
    for half in (0, 1):
        again = (F.col("event_id") % 20 == 0) & F.lit(half == 1)
        events(spark, sf_dir).where((F.col("event_id") % 2 == half) | again).coalesce(1).write.mode("append").parquet(landed)
    ticks = spark.readStream.schema(events(spark, sf_dir).schema).option("maxFilesPerTrigger", 1).parquet(landed)
    streams.upsert_stream(ticks, store, cs.scratch(spark), "event_type", "ts", "value", "event_id", "60 days").awaitTermination()
    return bars_out(cs.scan(spark, store))


# studies


def example(name: str, fast: int = 20, slow: int = 50) -> study.Study:
    """Studies on all hourly bars of all series: golden_cross, rsi_reclaim, sma_overlay."""
    n = study.Node
    data = n("candles", study.SOURCE, {"interval": "1h", "start_ms": 0, "end_ms": 1 << 50})
    sma = lambda i, p: n(i, "indicator.sma", {"period": p})
    close = "candles.close"
    if name == "golden_cross":
        return study.Study(name, (data, sma("fast", fast), sma("slow", slow), n("cross", "logic.crossover")), ((close, "fast.input"), (close, "slow.input"), ("fast.value", "cross.fast"), ("slow.value", "cross.slow")))
    if name == "rsi_reclaim":
        nodes = (data, n("rsi", "indicator.rsi", {"period": 14}), sma("sma", 20), n("level", "literal.number", {"value": 30.0}), n("reclaim", "logic.crossover"))
        return study.Study(name, nodes, ((close, "rsi.input"), (close, "sma.input"), ("candles.timestamp", "level.reference"), ("rsi.value", "reclaim.fast"), ("level.value", "reclaim.slow")))
    return study.Study(name, (data, sma("sma", 20)), ((close, "sma.input"),))


def _named(df: DataFrame, **ports: str) -> DataFrame:
    return df.select("symbol", "timestamp", *(F.col(f"`{p}`").alias(n) for n, p in ports.items()))


@query
def study_golden_cross(spark, sf_dir):
    got = study.run_study(example("golden_cross", 3, 8), study.warehouse_source(minutes(spark, sf_dir)), ["cross.signal"])
    return _named(got, signal="cross.signal").where("signal").select("symbol", "timestamp")


@query
def study_rsi_reclaim(spark, sf_dir):
    got = study.run_study(example("rsi_reclaim"), study.warehouse_source(minutes(spark, sf_dir)), ["rsi.value", "reclaim.signal"])
    return rounded(_named(got, rsi="rsi.value", signal="reclaim.signal"), "rsi")


@query
def study_sma_overlay(spark, sf_dir):
    got = study.run_study(example("sma_overlay"), study.warehouse_source(minutes(spark, sf_dir)), ["candles.close", "sma.value"])
    return rounded(_named(got, close="candles.close", sma="sma.value"), "close", "sma")


@query
def study_all_markets(spark, sf_dir):
    both = minutes(spark, sf_dir).union(order_bars(spark, sf_dir))
    got = study.run_study(example("golden_cross", 3, 8), study.warehouse_source(both), ["cross.signal"])
    return _named(got, signal="cross.signal").groupBy("symbol").agg(F.count("*").alias("bars"), F.count_if("signal").alias("signals"))


@query
def study_outputs_long(spark, sf_dir):
    ports = ["candles.close", "sma.value"]
    got = study.run_study(example("sma_overlay"), study.warehouse_source(minutes(spark, sf_dir)), ports)
    long = study.long_form(got, ports).join(study.series_length(got).select("symbol", "bars"), "symbol")
    return rounded(long.select("symbol", "timestamp", "port", "value", "bars"), "value")


@query
def study_two_sources(spark, sf_dir):
    """Every market's closes against the mean of its own second source."""
    n = study.Node
    data = [n(i, study.SOURCE, {"interval": "1h", "start_ms": 0, "end_ms": 1 << 50}) for i in ("candles", "other")]
    two = study.Study("two", (*data, n("mean", "indicator.sma", {"period": 3}), n("above", "logic.gt")), (("other.close", "mean.input"), ("candles.close", "above.left"), ("mean.value", "above.right")))
    got = study.run_study(two, study.warehouse_source(minutes(spark, sf_dir)), ["candles.close", "mean.value", "above.signal"])
    return rounded(_named(got, close="candles.close", mean="mean.value", above="above.signal"), "close", "mean")


@query
def study_derived_outputs(spark, sf_dir):
    """The ports that a study's panes show: two panes of two layers for each event."""
    layer = lambda **ports: F.struct(F.create_map(*(x for k, v in ports.items() for x in (F.lit(k), v))).alias("ports"))
    signal = F.concat(F.lit("x"), (F.col("user_id") % 3).cast("string"), F.lit(".signal"))
    panes = [F.array(layer(close=F.lit("c.close"), line=F.lit("s.value")), layer(line=F.lit("f.value"))), F.array(layer(marker=signal), layer(line=F.lit("s.value"), close=F.lit("c.close")))]
    rows = events(spark, sf_dir).select(F.col("event_id").alias("id"), F.explode(F.array(*panes)).alias("layers"))
    return study.derived_outputs(rows).select("id", F.array_join("outputs", ",").alias("outputs"))


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A study for each event: candles, two averages and a signal, in which the id's last digit plants a fault."""
    e, k = F.col("event_id"), F.col("event_id") % 10
    text = F.lit
    params = lambda period, shown: F.create_map(text("period"), period.cast("string"), text("visible"), shown.cast("string"))
    node = lambda i, kind, period=None, shown=F.lit(True): F.struct(i.alias("id"), kind.alias("kind"), (params(period, shown) if period is not None else F.create_map().cast("map<string,string>")).alias("params"))
    edge = lambda a, b: F.struct(a.alias("from"), b.alias("to"))
    nodes = F.array(
        node(text("c"), text("datasource.candles")),
        node(text("f"), F.when(k == 1, "nope.thing").otherwise("indicator.sma"), F.col("user_id") % 30 + F.when(k == 2, -30).otherwise(1)),
        node(F.when(k == 3, "f").otherwise("s"), text("indicator.sma"), F.col("user_id") % 60 + 1, F.col("user_id") % 7 != 0),
        node(text("x"), text("logic.crossover")),
    )
    edges = F.array(
        edge(F.when(k == 4, "s.value").otherwise("c.close"), text("f.input")),
        edge(F.when(k == 4, "f.value").when(k == 5, "c.timestamp").otherwise("c.close"), text("s.input")),
        edge(F.when(k == 6, "f").otherwise("f.value"), text("x.fast")),
        edge(F.when(k == 7, "ghost.value").otherwise("s.value"), F.when(k == 8, "x.fast").when(k == 9, "x.medium").otherwise("x.slow")),
    )
    return events(spark, sf_dir).select(e.alias("id"), nodes.alias("nodes"), edges.alias("edges"))


@query
def study_audit(spark, sf_dir):
    return audit.audit(specs(spark, sf_dir), study.node_kinds(spark))


def param_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A study for each event, of a mean and two literals whose parameters are texts of all kinds."""
    pick = lambda column, *texts: F.get(F.array(*(F.lit(t) for t in texts)), (F.col(column) % len(texts)).cast("int"))
    node = lambda i, kind, name, value: F.struct(F.lit(i).alias("id"), F.lit(kind).alias("kind"), F.map_from_arrays(F.array(F.lit(name)), F.array(value)).alias("params"))
    nodes = F.array(
        node("s", "indicator.sma", "period", pick("event_id", "20", "0", "-3", "x", None, "2.5", " 14 ")),
        node("l", "literal.number", "value", pick("user_id", "30", "1e2", "abc", None, "NaN", "-.5")),
        node("b", "literal.bool", "value", pick("event_id", "true", "False", "yes", None)),
        node("u", "nope.thing", "period", F.lit("x")),
    )
    return events(spark, sf_dir).select(F.col("event_id").alias("id"), nodes.alias("nodes"))


@query
def study_bad_params(spark, sf_dir):
    return audit.bad_params(param_specs(spark, sf_dir), study.kind_params(spark))


@query
def study_warmup(spark, sf_dir):
    return study.warmup_bars(specs(spark, sf_dir), study.node_kinds(spark)).select("id", F.col("warmup_bars").cast("long").alias("warmup_bars"))
