"""DuckDB SQL with the results that the queries must give."""

from __future__ import annotations

START, END = 1704436200000, 1704825900000

TICKS = "SELECT event_type AS symbol, (epoch_us(ts) // 1000) AS ms, ts, event_id AS tie, value AS price FROM events"
ORDERS = "SELECT o_orderpriority AS symbol, (epoch_us(o_orderdate) // 1000) AS ms, o_orderdate AS ts, o_orderkey AS tie, o_totalprice AS price FROM orders"


def candles(ticks: str, bucket: str, name: str) -> str:
    """Bars of ticks by a bucket expression on ms or ts."""
    return f"""SELECT 'x' AS exchange, 'spot' AS category, symbol, '{name}' AS "interval", CAST({bucket} AS BIGINT) AS "timestamp",
        arg_min(price, (ts, tie)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, tie)) AS close, CAST(count(*) AS DOUBLE) AS volume
        FROM ({ticks}) GROUP BY symbol, CAST({bucket} AS BIGINT)"""


def every(ms: int) -> str:
    return f"ms - ms % {ms}"


def calendar(unit: str) -> str:
    return f"epoch_ms(date_trunc('{unit}', ts))"


MINUTES = candles(TICKS, every(60_000), "1min")
HOURS = candles(TICKS, every(3_600_000), "1h")
ORDER_MINUTES = candles(ORDERS, every(60_000), "1min")
OUT = 'exchange, category, symbol, "interval", "timestamp", round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume'
BOTH = f"({MINUTES}) UNION ALL ({ORDER_MINUTES})"
CATALOG = f"""SELECT exchange, category, symbol, "interval", min("timestamp") AS from_ts, max("timestamp") AS to_ts, count(*) AS record_count FROM ({BOTH}) GROUP BY ALL"""
W = 'OVER (PARTITION BY symbol ORDER BY "timestamp")'


def mean(p: int, value: str = "close") -> str:
    frame = f'OVER (PARTITION BY symbol ORDER BY "timestamp" ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)'
    return f"CASE WHEN count({value}) {frame} = {p} THEN avg({value}) {frame} END"


def bars(sql: str) -> str:
    return f"SELECT {OUT} FROM ({sql})"


def last(sql: str, n: int) -> str:
    return f"""SELECT * FROM ({sql}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY "timestamp" DESC) <= {n}"""


CROSSING = f"SELECT *, round({mean(3)}, 6) AS fast, round({mean(8)}, 6) AS slow FROM ({HOURS})"


def crossed(source: str, before: str, after: str) -> str:
    return f"""SELECT symbol, "timestamp", CASE WHEN lag(fast) {W} IS NULL OR lag(slow) {W} IS NULL OR fast IS NULL OR slow IS NULL THEN NULL
        ELSE lag(fast) {W} {before} lag(slow) {W} AND fast {after} slow END AS signal FROM ({source})"""


def signal(expr: str) -> str:
    return f'SELECT symbol, "timestamp", {expr} AS signal FROM ({CROSSING})'


def strict(a: str, op: str, b: str) -> str:
    return f"CASE WHEN ({a}) IS NULL OR ({b}) IS NULL THEN NULL ELSE ({a}) {op} ({b}) END"


NUMBERED = f"numbered AS (SELECT symbol, \"timestamp\", close, row_number() {W} AS n, close - lag(close) {W} AS d FROM ({HOURS}))"


def ema(p: int) -> str:
    k = f"(2.0::DOUBLE / {p + 1})"
    return f"""WITH RECURSIVE {NUMBERED}, seeds AS (SELECT symbol, avg(close) AS y FROM numbered WHERE n <= {p} GROUP BY symbol HAVING count(*) = {p}),
        run AS (SELECT symbol, CAST({p} AS BIGINT) AS n, y FROM seeds UNION ALL SELECT r.symbol, x.n, {k} * x.close + (1 - {k}) * r.y FROM run r JOIN numbered x ON x.symbol = r.symbol AND x.n = r.n + 1)
        SELECT x.symbol, x."timestamp", round(run.y, 6) AS ema FROM numbered x LEFT JOIN run ON run.symbol = x.symbol AND run.n = x.n"""


def rsi(p: int) -> str:
    return f"""WITH RECURSIVE {NUMBERED}, seeds AS (SELECT symbol, avg(greatest(d, 0)) AS g, avg(greatest(-d, 0)) AS l FROM numbered WHERE n BETWEEN 2 AND {p + 1} GROUP BY symbol HAVING count(*) = {p}),
        run AS (SELECT symbol, CAST({p + 1} AS BIGINT) AS n, g, l FROM seeds UNION ALL
            SELECT r.symbol, x.n, (r.g * {p - 1} + greatest(x.d, 0)) / {p}, (r.l * {p - 1} + greatest(-x.d, 0)) / {p} FROM run r JOIN numbered x ON x.symbol = r.symbol AND x.n = r.n + 1)
        SELECT x.symbol, x."timestamp", CASE WHEN run.g IS NULL THEN NULL WHEN run.g + run.l > 0 THEN 100 * run.g / (run.g + run.l) ELSE 0 END AS rsi
        FROM numbered x LEFT JOIN run ON run.symbol = x.symbol AND run.n = x.n"""


GAPPY = f"""SELECT * REPLACE (CASE WHEN "timestamp" // 3600000 % 5 <> 0 THEN close END AS close, CASE WHEN "timestamp" // 3600000 % 7 <> 0 THEN volume END AS volume) FROM ({HOURS})"""
RUNS = """SELECT event_id AS run_id, CASE WHEN user_id % 2 = 0 THEN 'ingest_candles' ELSE 'refresh_catalog' END AS kind, 'x' AS exchange, 'm' || (user_id % 50) AS category,
    event_type AS symbol, ['pending', 'running', 'completed', 'failed'][event_id % 4 + 1] AS status, (epoch_us(ts) // 1000) AS created_at FROM events"""
LINES = f"""SELECT symbol, "timestamp" // 1000 AS time, close + 1 AS value FROM ({HOURS}) WHERE "timestamp" // 3600000 % 3 = 0"""
UNITS = "['s', 'M', 'min', 'Hours', 'd', 'week', 'mo', 'YEARS', 'parsec', '', 'hr', 'WK', 'yr', ' Hours', 'min ']"
PRINTED = "['s', 'min', 'min', 'h', 'd', 'w', 'mo', 'y', NULL, NULL, 'h', 'w', 'y', NULL, 'min']"
TEXTS = f"(SELECT *, p IS NOT NULL AND n >= 1 AS good FROM (SELECT event_id, (event_id % 100) || {UNITS}[user_id % 15 + 1] AS text, event_id % 100 AS n, {PRINTED}[user_id % 15 + 1] AS p FROM events))"
FAULTS = """SELECT event_id AS id, * FROM (
    SELECT event_id, event_id % 10 AS k, user_id % 30 AS u, user_id % 60 AS v, user_id % 7 = 0 AS hidden FROM events)"""
K = f"(SELECT id, k, u, v, hidden FROM ({FAULTS}))"


def fault(name: str, detail: str, where: str) -> str:
    return f"SELECT id, '{name}' AS fault, '{detail}' AS detail FROM {K} WHERE {where}"


RANGE = candles(f"SELECT * FROM ({TICKS}) WHERE ms - ms % 60000 BETWEEN {START} AND {END}", every(3_600_000), "1h")
LATEST = last(candles(f"SELECT t.* FROM ({TICKS}) t JOIN (SELECT symbol, max(ms - ms % 60000) AS top FROM ({TICKS}) GROUP BY symbol) USING (symbol) WHERE ms - ms % 60000 >= top - 74 * 3600000", every(3_600_000), "1h"), 24)

ORACLES: dict[str, str] = {
    "candles_all": bars(MINUTES),
    "candles_range": bars(last(f"""SELECT * FROM ({MINUTES}) WHERE symbol = 'click' AND "timestamp" BETWEEN {START} AND {END}""", 500)),
    "write_roundtrip": bars(MINUTES),
    "candles_resampled": bars(last(candles(f"SELECT * FROM ({TICKS}) WHERE ms - ms % 60000 BETWEEN {START} AND {END}", every(14_400_000), "4h"), 10)),
    "candles_latest": bars(LATEST),
    "candles_last": bars(last(MINUTES, 700)),
    "incremental_upsert": bars(f"""WITH m AS ({MINUTES}), top AS (SELECT symbol, max("timestamp") AS t FROM m WHERE "timestamp" <= {END} GROUP BY symbol)
        SELECT m.* REPLACE (CASE WHEN "timestamp" >= coalesce(t, 0) AND "timestamp" >= {START} THEN close + 1 ELSE close END AS close) FROM m LEFT JOIN top USING (symbol)"""),
    "kline_decode": f"""SELECT symbol, 'spot' AS product_class, "timestamp", round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume
        FROM ({MINUTES}) WHERE "timestamp" // 86400000 % 7 <> 0 AND "timestamp" // 60000 % 11 <> 0""",
    "kline_rejects": f"""SELECT count(*) FILTER (WHERE "timestamp" // 60000 % 11 = 0 AND "timestamp" // 86400000 % 7 <> 0) + count(DISTINCT CASE WHEN "timestamp" // 86400000 % 7 = 0 THEN symbol || ("timestamp" // 86400000) END) AS rejects,
        count(DISTINCT CASE WHEN "timestamp" // 86400000 % 7 = 0 THEN symbol || ("timestamp" // 86400000) END) AS failed_pages FROM ({MINUTES})""",
    "kline_history": bars(f'SELECT * FROM ({MINUTES}) WHERE "timestamp" // 86400000 % 7 <> 0 AND "timestamp" // 60000 % 11 <> 0'),
    "fetch_plan": f"""WITH b AS (SELECT symbol, min("timestamp") AS a, max("timestamp") AS z FROM ({MINUTES}) GROUP BY symbol)
        SELECT symbol, '1' AS code, low AS page_start, least(z, low + 999 * 60000) AS page_end FROM (SELECT symbol, z, unnest(range(a, z, 60000000)) AS low FROM b WHERE a < z)""",
    "partition_columns": f"""SELECT symbol, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day, count(*) AS bars
        FROM (SELECT symbol, make_timestamp("timestamp" * 1000) AS d FROM ({MINUTES})) GROUP BY ALL""",
    "resample_5m": bars(candles(TICKS, every(300_000), "5min")),
    "resample_1h": bars(HOURS),
    "resample_1d": bars(candles(TICKS, every(86_400_000), "1d")),
    "resample_1w": bars(candles(ORDERS, calendar("week"), "1w")),
    "resample_1mo": bars(candles(ORDERS, calendar("month"), "1mo")),
    "resample_1y": bars(candles(ORDERS, calendar("year"), "1y")),
    "time_bounds": f'SELECT symbol, min("timestamp") AS from_ts, max("timestamp") AS to_ts FROM ({MINUTES}) GROUP BY symbol',
    "last_timestamp": f'SELECT symbol, max("timestamp") AS last_ts FROM ({MINUTES}) GROUP BY symbol',
    "catalog_snapshot": CATALOG,
    "catalog_store": CATALOG,
    "catalog_totals": f"SELECT count(*) AS datasets, CAST(sum(record_count) AS BIGINT) AS candles, max(to_ts) AS latest FROM ({CATALOG})",
    "catalog_search": f"SELECT * FROM ({CATALOG}) WHERE lower(symbol) LIKE '%ic%'",
    "catalog_lookup": f"""SELECT symbol, min("timestamp") AS from_ts, max("timestamp") AS to_ts FROM ({MINUTES}) WHERE "timestamp" BETWEEN {START} AND {END} GROUP BY symbol
        UNION ALL SELECT symbol, min("timestamp"), max("timestamp") FROM ({ORDER_MINUTES}) GROUP BY symbol""",
    "market_symbols": "SELECT DISTINCT event_type AS symbol FROM events UNION SELECT DISTINCT o_orderpriority FROM orders",
    "missing_symbols": "SELECT DISTINCT o_orderpriority AS symbol FROM orders EXCEPT SELECT event_type FROM events",
    "selected_symbols": "SELECT DISTINCT symbol FROM (SELECT event_type AS symbol FROM events UNION SELECT o_orderpriority FROM orders) WHERE contains(symbol, 'i')",
    "null_audit": "".join(f"{'' if i == 0 else ' UNION ALL '}SELECT '{c}' AS column_name, count(*) FILTER (WHERE \"{c}\" IS NULL) AS nulls FROM ({GAPPY})" for i, c in enumerate(("timestamp", "open", "high", "low", "close", "volume"))),
    "bar_duration": f'SELECT symbol, CASE WHEN count(*) <= 1 THEN 60000 ELSE greatest(1, (max("timestamp") - min("timestamp")) // (count(*) - 1)) END AS bar_ms FROM ({MINUTES}) GROUP BY symbol',
    "dedup_keep_last": "SELECT event_type, (epoch_us(ts) // 1000) // 3600000 * 3600000 AS hour, max(event_id) AS event_id, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY ALL",
    "merge_candles": bars(f"""WITH h AS ({HOURS}), f AS (SELECT * REPLACE ("timestamp" + 43200000 AS "timestamp", close * 2 AS close) FROM h WHERE "timestamp" >= {START})
        SELECT * FROM f UNION ALL SELECT h.* FROM h ANTI JOIN f ON h.symbol = f.symbol AND h."timestamp" = f."timestamp\""""),
    "sma_20": f'SELECT symbol, "timestamp", round({mean(20)}, 6) AS sma FROM ({HOURS})',
    "ema_20": ema(20),
    "rsi_14": f'SELECT symbol, "timestamp", round(rsi, 6) AS rsi FROM ({rsi(14)})',
    "gt_sma": signal("fast > slow"),
    "lt_threshold": signal("fast < 50.0"),
    "and_strict": signal(strict("close > 50.0", "AND", "fast > slow")),
    "or_strict": signal(strict("close > 50.0", "OR", "fast > slow")),
    "crossover_sma": crossed(CROSSING, "<=", ">"),
    "crossunder_sma": crossed(CROSSING, ">=", "<"),
    "two_source_align": f"""SELECT a."timestamp", round(a.close, 6) AS left_close, round(b.close, 6) AS right_close FROM ({HOURS}) a JOIN ({HOURS}) b ON a."timestamp" = b."timestamp" AND a.symbol = 'click' AND b.symbol = 'view'""",
    "warmup_trim": last(f'SELECT symbol, "timestamp", round({mean(20)}, 6) AS sma FROM ({HOURS})', 50),
    "history_page": f"""WITH o AS (SELECT symbol, "timestamp", min("timestamp") OVER (PARTITION BY symbol) AS a FROM ({HOURS}) WHERE "timestamp" < {END}), p AS ({last("SELECT * FROM o", 60)})
        SELECT symbol, "timestamp", min("timestamp") OVER (PARTITION BY symbol) > a AS has_more FROM p""",
    "complete_candles": bars(f"SELECT * FROM ({GAPPY}) WHERE close IS NOT NULL AND volume IS NOT NULL"),
    "signal_markers": f"""SELECT symbol, "timestamp" // 1000 AS time, 'arrowUp' AS shape, 'belowBar' AS position FROM ({crossed(CROSSING, "<=", ">")}) WHERE signal""",
    "valued_points": f'SELECT symbol, "timestamp", round(close, 6) AS close FROM ({GAPPY}) WHERE close IS NOT NULL',
    "align_line": f"""SELECT h.symbol, h."timestamp" // 1000 AS time, round(l.value, 6) AS value FROM ({HOURS}) h LEFT JOIN ({LINES}) l ON l.symbol = h.symbol AND l.time = h."timestamp" // 1000""",
    "volume_bars": f'SELECT symbol, "timestamp" // 1000 AS time, volume, close >= open AS is_up FROM ({HOURS})',
    "interval_parse": f"SELECT event_id, text, CASE WHEN good THEN n END AS n, CASE WHEN good THEN n || p END AS printed FROM {TEXTS}",
    "interval_code": f"""SELECT event_id, text, CASE WHEN NOT good THEN NULL WHEN p = 'min' AND n IN (1, 3, 5, 15, 30) THEN CAST(n AS VARCHAR) WHEN p = 'h' AND n IN (1, 2, 4, 6, 12) THEN CAST(n * 60 AS VARCHAR)
        WHEN p = 'd' THEN 'D' WHEN p = 'w' THEN 'W' WHEN p = 'mo' THEN 'M' END AS code FROM {TEXTS}""",
    "load_many_requests": " UNION ALL ".join(f"SELECT {k} AS request, {OUT} FROM ({sql})" for k, sql in enumerate([RANGE, RANGE, LATEST, last(candles(f"SELECT * FROM ({TICKS}) WHERE ms - ms % 60000 BETWEEN {START} AND {START + 60 * 3_600_000}", every(3_600_000), "1h"), 10)])),
    "sma_nan": f"""WITH g AS (SELECT symbol, "timestamp", CASE WHEN "timestamp" // 3600000 % 5 <> 0 THEN close END AS close FROM ({HOURS})), m AS (SELECT *, round({mean(3)}, 6) AS sma FROM g)
        SELECT symbol, "timestamp", sma, round(close, 6) > sma AS signal FROM m""",
    "stream_upsert_two_batches": bars(MINUTES),
    "catalog_bytes": f'SELECT exchange, category, symbol, "interval", record_count, TRUE AS has_bytes, TRUE AS written_before, CAST(1 AS BIGINT) AS version FROM ({CATALOG})',
    "study_two_sources": f'SELECT symbol, "timestamp", round(close, 6) AS close, round({mean(3)}, 6) AS mean, close > {mean(3)} AS above FROM ({HOURS})',
    "study_derived_outputs": "SELECT event_id AS id, 'c.close,f.value,s.value,x' || (user_id % 3) || '.signal' AS outputs FROM events",
    "resolve_window": f"""WITH b AS (SELECT symbol, min("timestamp") AS a, max("timestamp") AS z FROM ({MINUTES}) GROUP BY symbol),
        r AS (SELECT event_id, event_type AS symbol, CASE WHEN event_id % 8 >= 4 THEN (epoch_us(ts) // 1000) END AS s, CASE WHEN event_id % 8 IN (2, 3, 6, 7) THEN (epoch_us(ts) // 1000) + (user_id % 5 - 1) * 86400000 END AS e, CASE WHEN event_id % 2 = 1 THEN event_id % 600 + 1 END AS n FROM events),
        m AS (SELECT *, CASE WHEN n IS NOT NULL THEN n WHEN s IS NULL OR e IS NULL THEN 1000 END AS most FROM r JOIN b USING (symbol)),
        w AS (SELECT *, greatest(coalesce(s, coalesce(e, z) - (most + 50) * 3600000), a) AS first, least(coalesce(e, s + (most + 50) * 3600000, z), z) AS last FROM m),
        x AS (SELECT *, coalesce(s > e, FALSE) OR first > last AS rejected FROM w)
        SELECT event_id, CASE WHEN NOT rejected THEN first END AS start_ms, CASE WHEN NOT rejected THEN last END AS end_ms, CASE WHEN NOT rejected THEN most END AS row_limit, rejected FROM x""",
    "runlog_recent": f"SELECT run_id, status, created_at FROM ({RUNS}) WHERE kind = 'ingest_candles' AND status IN ('completed', 'failed') ORDER BY created_at DESC, run_id DESC LIMIT 500",
    "runlog_summary": f"SELECT count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status IN ('pending', 'running')) AS active FROM ({RUNS})",
    "runlog_dedup": f"""WITH r AS (SELECT *, kind || ':' || exchange || ':' || category || ':' || upper(symbol) AS signature FROM ({RUNS}))
        SELECT run_id, signature FROM r WHERE created_at >= {START} AND signature IN (SELECT signature FROM r WHERE created_at < {START} AND run_id % 3 = 0 AND status IN ('pending', 'running'))""",
    "stream_resample": bars(f"""SELECT * FROM ({HOURS}) WHERE "timestamp" + 3600000 <= (SELECT (epoch_us(max(ts)) // 1000) - 600000 FROM events)"""),
    "stream_upsert": bars(MINUTES),
    "study_golden_cross": f'SELECT symbol, "timestamp" FROM ({crossed(CROSSING, "<=", ">")}) WHERE signal',
    "study_rsi_reclaim": f"""WITH v AS ({rsi(14)}) SELECT symbol, "timestamp", round(rsi, 6) AS rsi, CASE WHEN rsi IS NULL OR lag(rsi) {W} IS NULL THEN NULL ELSE lag(rsi) {W} <= 30 AND rsi > 30 END AS signal FROM v""",
    "study_sma_overlay": f'SELECT symbol, "timestamp", round(close, 6) AS close, round({mean(20)}, 6) AS sma FROM ({HOURS})',
    "study_all_markets": f"""WITH h AS (({HOURS}) UNION ALL ({candles(ORDERS, every(3_600_000), "1h")})), c AS (SELECT *, {mean(3)} AS fast, {mean(8)} AS slow FROM h)
        SELECT symbol, count(*) AS bars, count(*) FILTER (WHERE signal) AS signals FROM ({crossed("SELECT * FROM c", "<=", ">")}) GROUP BY symbol""",
    "study_outputs_long": f"""WITH s AS (SELECT symbol, "timestamp", close, {mean(20)} AS sma, count(*) OVER (PARTITION BY symbol) AS bars FROM ({HOURS}))
        SELECT symbol, "timestamp", 'candles.close' AS port, round(close, 6) AS value, bars FROM s UNION ALL SELECT symbol, "timestamp", 'sma.value', round(sma, 6), bars FROM s""",
    "study_audit": " UNION ALL ".join([
        fault("unknown_kind", "f", "k = 1"),
        fault("duplicate_node", "f", "k = 3"),
        fault("bad_period", "f", "k = 2"),
        fault("unknown_node", "s.input", "k = 3"),
        fault("unknown_node", "s.value", "k = 3"),
        fault("cycle", "", "k = 4"),
        fault("type_mismatch", "s.input", "k = 5"),
        fault("bad_port", "f", "k = 6"),
        fault("unknown_node", "ghost.value", "k = 7"),
        fault("double_wire", "x.fast", "k = 8"),
        fault("unwired_input", "x.slow", "k IN (8, 9)"),
        fault("unknown_port", "x.medium", "k = 9"),
    ]),
    "study_bad_params": """WITH given AS (
        SELECT event_id AS id, 's' AS node, 'period' AS param, trim(['20', '0', '-3', 'x', NULL, '2.5', ' 14 '][event_id % 7 + 1]) AS v FROM events
        UNION ALL SELECT event_id, 'l', 'value', ['30', '1e2', 'abc', NULL, 'NaN', '-.5'][user_id % 6 + 1] FROM events
        UNION ALL SELECT event_id, 'b', 'value', ['true', 'False', 'yes', NULL][event_id % 4 + 1] FROM events)
        SELECT id, node, param, fault FROM (SELECT *, CASE WHEN v IS NULL THEN CASE WHEN node = 's' THEN 'missing' END
            WHEN node = 's' THEN CASE WHEN try_cast(v AS BIGINT) IS NULL OR contains(v, '.') THEN 'wrong_type' WHEN try_cast(v AS BIGINT) < 1 THEN 'out_of_bounds' END
            WHEN node = 'l' THEN CASE WHEN try_cast(v AS DOUBLE) IS NULL OR isnan(try_cast(v AS DOUBLE)) THEN 'wrong_type' END
            WHEN lower(v) NOT IN ('true', 'false') THEN 'wrong_type' END AS fault FROM given) WHERE fault IS NOT NULL""",
    "study_warmup": f"SELECT id, CAST(CASE WHEN hidden AND k = 1 THEN 0 ELSE greatest(20, CASE WHEN NOT hidden THEN v + 1 ELSE 0 END, CASE k WHEN 1 THEN 0 WHEN 2 THEN u - 30 ELSE u + 1 END) END AS BIGINT) AS warmup_bars FROM {K}",
}
