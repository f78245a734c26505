"""Studies: declarative graphs of sources, indicators and signals, run over all series at once.

A study's nodes become columns `node.port` of one bar table, in topological order; only what the requested
outputs need is built, and nothing runs before an action. Nodes that look back on a known number of bars run together by
chunks of a series with a common halo (chunks.py); others see the whole table. User kinds join by register(),
register_columns() and register_grouped().
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from graphlib import CycleError, TopologicalSorter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from barwright.functions import logic
from barwright.functions.interval import Interval
from barwright.operators import catalog, indicators
from barwright.operators.chunks import ROWS, along, in_chunk, last_rows
from barwright.operators.resample import resample
from barwright.operators.windows import load, load_stored
from barwright.sources.candles import KEYS, PRICES, time_filter

# Fixed value: a study's kind.
CHART = "chart"


class StudyError(ValueError):
    """The graph or the request is at fault."""


class NotFound(StudyError):
    """A named node or port isn't there."""


@dataclass(frozen=True)
class Node:
    id: str
    kind: str
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Study:
    id: str
    nodes: tuple[Node, ...]
    edges: tuple[tuple[str, str], ...]
    version: int = 1

    @classmethod
    def from_json(cls, text: str) -> Study:
        raw = json.loads(text)
        if raw.get("kind", CHART) != CHART:
            raise StudyError(f"kind of study: {raw['kind']!r}")
        return cls(raw["id"], tuple(Node(n["id"], n["kind"], n.get("params") or {}) for n in raw["nodes"]), tuple((e["from"], e["to"]) for e in raw["edges"]), raw.get("version", 1))

    def to_json(self) -> str:
        nodes = [{"id": n.id, "kind": n.kind, "params": n.params} for n in self.nodes]
        return json.dumps({"id": self.id, "version": self.version, "kind": CHART, "nodes": nodes, "edges": [{"from": a, "to": b} for a, b in self.edges]})

    def with_window(self, **window: int) -> Study:
        """The study with start_ms, end_ms or limit set on its data sources."""
        return replace(self, nodes=tuple(replace(n, params=n.params | window) if n.kind == SOURCE else n for n in self.nodes))


def split_port(text: str) -> tuple[str, str]:
    node, dot, port = text.partition(".")
    if not node or not port or "." in port:
        raise StudyError(f"not a port: {text!r}")
    return node, port


@dataclass(frozen=True)
class Param:
    """A parameter of a kind: its type (integer, number, string or boolean), the default that is shown and, unless it must be given, used, and its bounds."""

    name: str
    type: str
    default: object = None
    least: float | None = None
    most: float | None = None
    required: bool = False

    def __post_init__(self):
        if self.type not in ("integer", "number", "string", "boolean"):
            raise ValueError(f"type of parameter {self.name}: {self.type!r}")

    def read(self, given: dict) -> object:
        """The value, from one of its type or a text of it; StudyError if it is missing, of another type or out of bounds."""
        value = given.get(self.name)
        if value is None:
            if self.required:
                raise StudyError(f"parameter {self.name} is missing")
            return self.default
        text = str(value).strip()
        if self.type == "boolean":
            if text.lower() not in ("true", "false"):
                raise StudyError(f"parameter {self.name} is no boolean: {value!r}")
            return text.lower() == "true"
        if self.type == "string":
            if not isinstance(value, str):
                raise StudyError(f"parameter {self.name} is no text: {value!r}")
            return value
        if isinstance(value, bool) or not re.fullmatch(INTEGER if self.type == "integer" else NUMBER, text):
            raise StudyError(f"parameter {self.name} is no {self.type}: {value!r}")
        number = int(text) if self.type == "integer" else float(text)
        if (self.least is not None and number < self.least) or (self.most is not None and number > self.most):
            raise StudyError(f"parameter {self.name} is out of bounds: {value!r}")
        return number


#: Texts of numbers, the same for single studies and for tables of them; an integer has up to 18 digits.
INTEGER, NUMBER = r"[+-]?[0-9]{1,18}", r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,2})?"


@dataclass(frozen=True)
class Kind:
    """A node kind: ports with their types, parameters, warmup bars, and apply(df, wires, params, out) -> df.

    `lookback` gives the bars before its own that a node of these parameters looks at; such a node's windows are by in_chunk(), and
    it keeps columns and bars. Without it the node gets the whole table, not cut into chunks.
    """

    name: str
    inputs: dict[str, str]
    outputs: dict[str, str]
    apply: Callable[[DataFrame, dict[str, str], dict, Callable[[str], str]], DataFrame]
    params: tuple[Param, ...] = ()
    warmup: int = 0
    lookback: Callable[[dict], int] | None = None

    def values(self, given: dict) -> dict:
        """The given parameters with the declared ones read."""
        return given | {p.name: p.read(given) for p in self.params}


KINDS: dict[str, Kind] = {}


def register(kind: Kind) -> Kind:
    KINDS[kind.name] = kind
    return kind


def register_columns(name: str, inputs: dict[str, str], outputs: dict[str, str], fn: Callable[[dict[str, Column], dict], dict[str, Column]], params: tuple[Param, ...] = (), lookback: int = 0) -> Kind:
    """A kind whose outputs are column expressions of its inputs; those with windows over in_chunk() say how many bars they look back."""

    def apply(df: DataFrame, wires: dict[str, str], values: dict, out: Callable[[str], str]) -> DataFrame:
        made = fn({p: F.col(f"`{c}`") for p, c in wires.items()}, values)
        return df.withColumns({out(p): c for p, c in made.items()})

    return register(Kind(name, inputs, outputs, apply, params, lookback=lambda values: lookback))


def register_grouped(name: str, inputs: dict[str, str], outputs: dict[str, str], fn: Callable[[pd.DataFrame, dict], pd.DataFrame], params: tuple[Param, ...] = (), lookback: int | Callable[[dict], int] = 0) -> Kind:
    """A kind that is no column expression: fn gets a chunk's bars in time's order, with a column for timestamp and each input, and gives the outputs row by row.

    A chunk has about ROWS bars besides its halo, so a task's memory doesn't grow with a series; what fn makes of a bar may
    depend on the `lookback` bars before it, no more.
    """

    def apply(df: DataFrame, wires: dict[str, str], values: dict, out: Callable[[str], str]) -> DataFrame:
        # names of columns may hold dots, which the grouping takes for fields
        plain = {c: c.replace(".", "__") for c in df.columns}
        schema = StructType([*(StructField(plain[f.name], f.dataType) for f in df.schema.fields), *(StructField(p, _parse_datatype_string(t)) for p, t in outputs.items())])

        def run(bars: pd.DataFrame) -> pd.DataFrame:
            bars = bars.sort_values("timestamp", kind="stable").reset_index(drop=True)
            made = fn(pd.DataFrame({"timestamp": bars["timestamp"], **{p: bars[plain[c]] for p, c in wires.items()}}), values)
            return pd.DataFrame({**{c: bars[c] for c in bars.columns}, **{f"_out_{p}": made[p].to_numpy() for p in outputs}}).set_axis(schema.names, axis=1)

        made = df.toDF(*plain.values()).groupBy(*KEYS, "_chunk").applyInPandas(run, schema)
        return made.toDF(*df.columns, *map(out, outputs))

    return register(Kind(name, inputs, outputs, apply, params, lookback=lookback if callable(lookback) else lambda values: lookback))


def _indicator(name: str, apply: Callable, warmup: int, lookback: Callable[[dict], int] | None = None) -> None:
    period = Param("period", "integer", default=warmup, least=1, required=True)
    register(Kind(name, {"input": "double"}, {"value": "double"}, apply, (period,), warmup, lookback))


# Node kinds, their ports, parameters and warmup bars.
SOURCE = "datasource.candles"
SERIES = {"timestamp": "bigint", **dict.fromkeys(PRICES, "double")}
register(Kind(SOURCE, {}, SERIES, lambda df, wires, params, out: df.withColumns({out(p): F.col(p) for p in SERIES}), tuple(Param(k, "string") for k in KEYS), lookback=lambda values: 0))
_indicator("indicator.sma", lambda df, wires, p, out: df.withColumn(out("value"), indicators.sma(F.col(f"`{wires['input']}`"), p["period"], in_chunk())), 20, lambda values: values["period"] - 1)
_indicator("indicator.ema", lambda df, wires, p, out: indicators.ema(df, wires["input"], p["period"], out("value")), 20)
_indicator("indicator.rsi", lambda df, wires, p, out: indicators.rsi(df, wires["input"], p["period"], out("value")), 14)
register_columns("literal.number", {"reference": "bigint"}, {"value": "double"}, lambda i, p: {"value": F.lit(float(p["value"]))}, (Param("value", "number", 0.0),))
register_columns("literal.bool", {"reference": "bigint"}, {"value": "boolean"}, lambda i, p: {"value": F.lit(p["value"])}, (Param("value", "boolean", False),))
for _name, _fn in (("crossover", logic.crossover), ("crossunder", logic.crossunder)):
    register_columns(f"logic.{_name}", {"fast": "double", "slow": "double"}, {"signal": "boolean"}, lambda i, p, f=_fn: {"signal": f(i["fast"], i["slow"], in_chunk())}, lookback=1)
for _name, _fn, _type in (("gt", logic.gt, "double"), ("lt", logic.lt, "double"), ("and", logic.and_, "boolean"), ("or", logic.or_, "boolean")):
    register_columns(f"logic.{_name}", {"left": _type, "right": _type}, {"signal": "boolean"}, lambda i, p, f=_fn: {"signal": f(i["left"], i["right"])})


def node_kinds(spark: SparkSession) -> DataFrame:
    """One row for each port of each kind: kind, warmup, direction, port, type."""
    rows = [(k.name, k.warmup, way, p, t) for k in KINDS.values() for way, ports in (("in", k.inputs), ("out", k.outputs)) for p, t in ports.items()]
    return spark.createDataFrame(sorted(rows), "kind string, warmup int, direction string, port string, type string")


def kind_params(spark: SparkSession) -> DataFrame:
    """One row for each parameter of each kind: kind, param, type, default (as text), least, most, required."""
    text = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    bound = lambda v: None if v is None else float(v)
    rows = [(k.name, p.name, p.type, text(p.default), bound(p.least), bound(p.most), p.required) for k in KINDS.values() for p in k.params]
    return spark.createDataFrame(sorted(rows, key=lambda r: r[:2]), "kind string, param string, type string, default string, least double, most double, required boolean")


def check(study: Study) -> list[Node]:
    """The nodes in topological order, ties by id; raises StudyError at the first fault."""
    nodes = {n.id: n for n in study.nodes}
    if len(nodes) < len(study.nodes):
        raise StudyError("two nodes have the same id")
    for n in study.nodes:
        if n.kind not in KINDS:
            raise StudyError(f"unknown kind {n.kind!r} of node {n.id!r}")
    wired: set[str] = set()
    before: dict[str, set[str]] = {i: set() for i in sorted(nodes)}
    for source, target in study.edges:
        (a, p), (b, q) = split_port(source), split_port(target)
        if a not in nodes or b not in nodes:
            raise NotFound(f"edge {source} -> {target} names an unknown node")
        if p not in KINDS[nodes[a].kind].outputs or q not in KINDS[nodes[b].kind].inputs:
            raise NotFound(f"edge {source} -> {target} names an unknown port")
        if KINDS[nodes[a].kind].outputs[p] != KINDS[nodes[b].kind].inputs[q]:
            raise StudyError(f"edge {source} -> {target} joins different types")
        if target in wired:
            raise StudyError(f"input {target} is wired twice")
        wired.add(target)
        before[b].add(a)
    order, sorter = [], TopologicalSorter(before)
    try:
        sorter.prepare()
    except CycleError:
        raise StudyError("the graph has a cycle") from None
    while sorter.is_active():
        ready = sorted(sorter.get_ready())
        order += ready
        sorter.done(*ready)
    return [nodes[i] for i in order]


Source = Callable[[dict], DataFrame]


def _wanted(params: dict) -> tuple[dict, dict]:
    """(named keys, window) of a data source's parameters."""
    return {k: params[k] for k in KEYS[:3] if params.get(k) is not None}, {"start": params.get("start_ms"), "end": params.get("end_ms"), "limit": params.get("limit")}


def _requests(bounds: DataFrame, named: dict, window: dict) -> DataFrame:
    for k, v in named.items():
        bounds = bounds.where(F.col(k) == v)
    return bounds.select(*KEYS).withColumns({c: F.lit(v).cast("long") for c, v in window.items()})


def warehouse_source(candles: DataFrame, bounds: DataFrame | None = None) -> Source:
    """Bars of a data source node's parameters; without a market in them, of all series.

    A range with both ends needs no bounds and reads the candles once. Other windows need the series' bounds: the catalog's
    (keys, from, to), or those of the candles.
    """

    def bars(params: dict) -> DataFrame:
        named, window = _wanted(params)
        interval, held = params.get("interval") or "1min", candles
        for k, v in named.items():
            held = held.where(F.col(k) == v)
        if window["start"] is not None and window["end"] is not None:
            held = time_filter(held, window["start"], window["end"])
            if Interval.parse(interval) != Interval(1, "m"):
                held = resample(held, interval).select(*KEYS, "timestamp", *PRICES)
            return held if window["limit"] is None else last_rows(held, int(window["limit"]))
        known = catalog.time_bounds(held) if bounds is None else bounds
        return load(held, _requests(known, named, window), interval, bounds=known)

    return bars


def stored_source(spark: SparkSession, path: str) -> Source:
    """Bars of a store, whose files' footers give the series and their bounds; only the days of the windows are read, once."""

    def bars(params: dict) -> DataFrame:
        named, window = _wanted(params)
        known = catalog.of_store(spark, path)
        return load_stored(spark, path, _requests(known, named, window), known, params.get("interval") or "1min")

    return bars


def _staged(order: list[Node], wires: dict[str, str]) -> list[tuple[list[Node], int | None]]:
    """The nodes in steps: one that needs the whole table (None), or several that run by chunks, with the bars they look back on together."""
    todo, done, steps = list(order), set(), []
    while todo:
        back, step = {}, []
        for n in todo:
            kind = KINDS[n.kind]
            before = [split_port(wires[f"{n.id}.{p}"])[0] for p in kind.inputs]
            if kind.lookback is not None and all(b in done or b in back for b in before):
                back[n.id] = kind.lookback(kind.values(n.params)) + max((back.get(b, 0) for b in before), default=0)
                step.append(n)
        if step:
            steps.append((step, max(back.values())))
            done |= set(back)
        todo = [n for n in todo if n.id not in done]
        whole = [n for n in todo if KINDS[n.kind].lookback is None and all(split_port(wires[f"{n.id}.{p}"])[0] in done for p in KINDS[n.kind].inputs)]
        steps += [([n], None) for n in whole]
        done |= {n.id for n in whole}
        todo = [n for n in todo if n.id not in done]
    return steps


def run_study(study: Study, source: Source, outputs: list[str], rows: int = ROWS) -> DataFrame:
    """Keys, timestamp and a column for each requested port. Bars are limited before indicators see them; `rows` is a chunk's length."""
    if not outputs or len(set(outputs)) < len(outputs):
        raise StudyError("outputs must be named, and once each")
    order = check(study)
    nodes = {n.id: n for n in order}
    for node, port in map(split_port, outputs):
        if node not in nodes or port not in KINDS[nodes[node].kind].outputs:
            raise NotFound(f"no port {node}.{port}")
    wires = {b: a for a, b in study.edges}
    needed, todo = set(), [split_port(o)[0] for o in outputs]
    while todo:
        if (i := todo.pop()) not in needed:
            needed.add(i)
            for port in KINDS[nodes[i].kind].inputs:
                if f"{i}.{port}" not in wires:
                    raise StudyError(f"input {i}.{port} isn't wired")
                todo.append(split_port(wires[f"{i}.{port}"])[0])
    frames = [n for n in order if n.id in needed and n.kind == SOURCE]
    if not frames:
        raise StudyError("the outputs depend on no data source")
    df = source(frames[0].params)
    for other in frames[1:]:
        # a source that names one market meets every series on its times, others meet the same market's
        on = ["timestamp"] if all(other.params.get(k) is not None for k in KEYS[:3]) else [*KEYS[:3], "timestamp"]
        names = {p: f"{other.id}.{p}" for p in SERIES}
        df = df.join(source(other.params).select(*on, *(F.col(p).alias(c) for p, c in names.items())), on)

    def applied(df: DataFrame, nodes: list[Node]) -> DataFrame:
        for n in nodes:
            if n not in frames[1:]:
                kind = KINDS[n.kind]
                df = kind.apply(df, {p: wires[f"{n.id}.{p}"] for p in kind.inputs}, kind.values(n.params), lambda port, i=n.id: f"{i}.{port}")
        return df

    bars = df  # nodes keep them, so days are counted before indicators
    for step, lookback in _staged([n for n in order if n.id in needed], wires):
        df = applied(df, step) if lookback is None else along(df, lookback, lambda cut, step=step: applied(cut, step), rows, bars)
    return df.select(*KEYS, "timestamp", *(F.col(f"`{o}`") for o in outputs))


def long_form(result: DataFrame, outputs: list[str]) -> DataFrame:
    """(keys, timestamp, port, value): booleans as 1 and 0."""
    values = [F.col(f"`{o}`").cast("double").alias(o.replace(".", "__")) for o in outputs]
    wide = result.select(*KEYS, "timestamp", *values)
    named = wide.unpivot([*KEYS, "timestamp"], [o.replace(".", "__") for o in outputs], "port", "value")
    return named.withColumn("port", F.regexp_replace("port", "__", "."))


def series_length(result: DataFrame) -> DataFrame:
    return result.groupBy(*KEYS).agg(F.count("*").alias("bars"))


def align_sources(left: DataFrame, right: DataFrame, by: str = "timestamp") -> DataFrame:
    """Two series' closes side by side: on equal times, or by position, which asks for equal lengths."""
    if by == "timestamp":
        return left.select("timestamp", F.col("close").alias("left_close")).join(right.select("timestamp", F.col("close").alias("right_close")), "timestamp")
    if left.count() != right.count():
        raise StudyError("series of different lengths can't be zipped")
    at = lambda d, name: indicators.placed(d, "_at").select("_at", *(["timestamp"] if name == "left_close" else []), F.col("close").alias(name))
    return at(left, "left_close").join(at(right, "right_close"), "_at").drop("_at")


def derived_outputs(panes: DataFrame) -> DataFrame:
    """(id, outputs): of panes (id, layers with a map of ports), the ports of all layers, once each and sorted."""
    layer = panes.select("id", F.explode_outer("layers").alias("layer"))
    ports = layer.select("id", F.explode_outer(F.map_values("layer.ports")).alias("port"))
    return ports.groupBy("id").agg(F.sort_array(F.collect_set("port")).alias("outputs"))  # a study's own ports


def warmup_bars(studies: DataFrame, kinds: DataFrame) -> DataFrame:
    """Bars that each study needs before its first shown one: the most of its indicators' period or default; nodes may be hidden."""
    node = studies.select("id", F.explode("nodes").alias("node")).where(F.coalesce(F.col("node.params")["visible"], F.lit("true")) != "false")
    known = kinds.where("warmup > 0").select("kind", "warmup").distinct()
    own = node.select("id", F.col("node.kind").alias("kind"), F.col("node.params")["period"].try_cast("int").alias("period")).join(F.broadcast(known), "kind")  # the registered kinds
    found = own.groupBy("id").agg(F.max(F.greatest("warmup", "period")).alias("warmup_bars"))
    return studies.select("id").join(found, "id", "left").na.fill(0)
