"""Audit of a table of studies: every fault of every graph, in one pass.

A study is a row with id, nodes (array of id, kind, params as map of strings) and edges (array of from, to). The registered kinds
become maps in the plan, and a row's faults follow from its own arrays, so nothing is joined or shuffled. Rows of the same id are
studies of their own; null arrays are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.plans.study import INTEGER, NUMBER

#: Rows of the tables of kinds and parameters, which become part of the plan.
MOST_KINDS = 10_000


def _rows(table: DataFrame) -> list:
    found = table.limit(MOST_KINDS + 1).collect()
    if len(found) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} ports or parameters of kinds")
    return found


def _map(values: dict[str, Column], kind: str) -> Column:
    made = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v)))
    return made.cast(f"map<string, {kind}>")


def _ports(kinds: DataFrame) -> dict[str, Column]:
    """For each direction a map of kinds to their ports' types; kinds without such ports are there too."""
    found: dict[str, dict[str, dict[str, str]]] = {"in": {}, "out": {}}
    for r in _rows(kinds):
        for way in found:
            own = found[way].setdefault(r["kind"], {})
            if r["direction"] == way:
                own[r["port"]] = r["type"]
    types = lambda own: _map({p: F.lit(t) for p, t in own.items()}, "string")
    return {way: _map({k: types(own) for k, own in held.items()}, "map<string, string>") for way, held in found.items()}


def _arrays(studies: DataFrame) -> DataFrame:
    """id, nodes and edges, in which an edge has its two ends' nodes and ports (null unless both parts are there and no more)."""
    part = lambda text, k: F.when(text.rlike(r"^[^.]+\.[^.]+$"), F.split_part(text, F.lit("."), F.lit(k)))
    ends = lambda e: F.struct(
        e["from"].alias("source"), e["to"].alias("target"), *(part(e[c], k).alias(f"{side}_{name}") for side, c in (("a", "from"), ("b", "to")) for k, name in ((1, "node"), (2, "port")))
    )
    whole = lambda c: F.coalesce(c, F.array().cast(studies.schema[c].dataType))
    return studies.select("id", whole("nodes").alias("nodes"), F.transform(whole("edges"), ends).alias("edges"))


def _repeated(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda v: F.size(F.filter(values, lambda w: w == v)) > 1))


def has_cycle(pairs: Column) -> Column:
    """Whether edges (a, b) hold a cycle: edges that begin where none ends are peeled off, as often as there are edges."""
    peeled = lambda held: F.filter(held, lambda x: F.exists(held, lambda y: y["b"] == x["a"]))
    return F.size(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1))), pairs, lambda held, _: peeled(held))) > 0


def audit(studies: DataFrame, kinds: DataFrame) -> DataFrame:
    """(id, fault, detail): duplicate_node, unknown_kind, bad_port, unknown_node, unknown_port, type_mismatch, double_wire, unwired_input, bad_period, cycle.

    Of nodes with the same id, the first gives the kind.
    """
    ports = _ports(kinds)
    nodes, edges = F.col("nodes"), F.col("edges")
    kind_of = lambda name: F.try_element_at(F.filter(nodes, lambda n: n["id"] == name), F.lit(1))["kind"]
    known = lambda kind: F.coalesce(F.map_contains_key(ports["in"], F.coalesce(kind, F.lit(""))), F.lit(False))
    sides = {"a": ("source", "out"), "b": ("target", "in")}
    typed = lambda e: F.struct(
        e["source"].alias("source"),
        e["target"].alias("target"),
        *(c for side, (_, way) in sides.items() for kind in [kind_of(e[f"{side}_node"])] for c in (kind.alias(f"{side}_kind"), ports[way][kind][e[f"{side}_port"]].alias(f"{side}_type"))),
    )
    rows = _arrays(studies).withColumn("sound", F.filter(edges, lambda e: e["a_node"].isNotNull() & e["b_node"].isNotNull()))
    rows = rows.withColumns({"typed": F.transform("sound", typed), "ids": F.transform(nodes, lambda n: n["id"])})
    wired = lambda target: F.exists(edges, lambda e: F.coalesce(e["target"] == target, F.lit(False)))
    wanted = lambda i: F.transform(F.coalesce(F.map_keys(ports["in"][kind_of(i)]), F.array().cast("array<string>")), lambda p: F.concat_ws(".", i, p))
    period = lambda n: n["params"]["period"].try_cast("int")
    of = lambda array, keep, detail: F.transform(F.filter(array, keep), lambda x: x[detail])
    unplaced = lambda side: lambda t: t[f"{side}_kind"].isNull()
    portless = lambda side: lambda t: known(t[f"{side}_kind"]) & t[f"{side}_type"].isNull()
    labelled = lambda fault: lambda x: F.struct(F.lit(fault).alias("fault"), x.alias("detail"))
    found = {
        "duplicate_node": [_repeated(F.col("ids"))],
        "unknown_kind": [of(nodes, lambda n: ~known(n["kind"]), "id")],
        "bad_port": [of(edges, lambda e: e["a_node"].isNull(), "source"), of(edges, lambda e: e["b_node"].isNull(), "target")],
        "double_wire": [_repeated(F.transform(edges, lambda e: e["target"]))],
        "unknown_node": [of("typed", unplaced(side), whole) for side, (whole, _) in sides.items()],
        "unknown_port": [of("typed", portless(side), whole) for side, (whole, _) in sides.items()],
        "type_mismatch": [of("typed", lambda t: F.coalesce(t["a_type"] != t["b_type"], F.lit(False)), "target")],
        "unwired_input": [F.filter(F.flatten(F.transform(F.array_distinct("ids"), wanted)), lambda t: ~wired(t))],
        "bad_period": [of(nodes, lambda n: n["kind"].startswith("indicator.") & (period(n).isNull() | (period(n) < 1)), "id")],
        "cycle": [F.when(has_cycle(F.array_distinct(F.transform("sound", lambda e: F.struct(e["a_node"].alias("a"), e["b_node"].alias("b"))))), F.array(F.lit("")))],
    }
    none = F.array().cast("array<string>")
    named = [F.transform(F.coalesce(d, none), labelled(fault)) for fault, details in found.items() for d in details]
    return rows.select("id", F.inline(F.array_distinct(F.concat(*named))))


def bad_params(studies: DataFrame, params: DataFrame) -> DataFrame:
    """(id, node, param, fault) of nodes' parameters against the table of declared ones: missing, wrong_type or out_of_bounds.

    Values are texts, blanks around them don't count; a parameter that isn't required may be missing, one that isn't declared may be anything.
    """
    declared: dict[str, list[Column]] = {}
    for r in _rows(params):
        bound = [F.lit(r[c]).cast("double").alias(c) for c in ("least", "most")]
        declared.setdefault(r["kind"], []).append(F.struct(F.lit(r["param"]).alias("param"), F.lit(r["type"]).alias("type"), *bound, F.lit(r["required"]).alias("required")))
    kind = "array<struct<param: string, type: string, least: double, most: double, required: boolean>>"
    table = _map({k: F.array(*own) for k, own in declared.items()}, kind)
    node = studies.select("id", F.explode("nodes").alias("n")).select("id", F.col("n.id").alias("node"), F.col("n.params").alias("given"), F.explode(table[F.col("n.kind")]).alias("p"))
    value = F.trim(F.element_at("given", F.col("p.param")))
    shape = {"integer": value.rlike(f"^({INTEGER})$"), "number": value.rlike(f"^({NUMBER})$"), "boolean": F.lower(value).isin("true", "false")}
    wrong = F.lit(False)
    for name, fits in shape.items():
        wrong = F.when(F.col("p.type") == name, ~fits).otherwise(wrong)
    number = value.try_cast("double")
    out = F.coalesce(number < F.col("p.least"), F.lit(False)) | F.coalesce(number > F.col("p.most"), F.lit(False))
    fault = F.when(value.isNull(), F.when(F.col("p.required"), "missing")).when(wrong, "wrong_type").when(out, "out_of_bounds")
    return node.select("id", "node", F.col("p.param").alias("param"), fault.alias("fault")).where("fault IS NOT NULL")
