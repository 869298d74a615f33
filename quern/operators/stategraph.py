"""Browser flows as graphs of states: targets that don't exist, states that nothing leads to, states that lead to no end.

A flow is one row from its text to its problems, so flows are dealt out evenly and nothing is shuffled by flow. Its states
and edges are taken from the text by expressions; each state and edge is looked at once in either direction.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.formats import json_value
from quern.session import spread

#: Fixed value: what is wrong with a flow without states.
NO_STATES = "states must contain at least one state"
NOT_JSON = "workflow must be a JSON object"


def _entries(v: Column) -> Column:
    return F.coalesce(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))


def _text(v: Column, name: str) -> Column:
    return F.nullif(F.try_variant_get(v, f"$.{name}", "string"), F.lit(""))


def _edges(state: Column) -> Column:
    """(place, via, target) of all that a state may go on to."""
    edge = lambda place, via, target: F.struct(F.lit(place).alias("place"), via.alias("via"), target.alias("target"))
    labelled = lambda place, name, target: F.transform(_entries(F.try_variant_get(state, f"$.{name}", "variant")), lambda e: edge(place, F.concat(F.lit(f'{name}["'), e["key"], F.lit('"]' + (".if_exists_goto" if place == 3 else ""))), target(e["value"])))
    plain = F.array(edge(0, F.lit("next"), _text(state, "next")), edge(1, F.lit("next_on_timeout"), _text(state, "next_on_timeout")))
    every = F.concat(plain, labelled(2, "next_map", lambda v: F.try_variant_get(v, "$", "string")), labelled(3, "validate_winner", lambda v: _text(v, "if_exists_goto")))
    return F.filter(every, lambda e: e["target"].isNotNull())


def _reached(start: Iterable[str], edges: dict[str, list[str]]) -> set[str]:
    """All that start reaches, itself included."""
    seen, open_ = set(start), list(start)
    while open_:
        fresh = [x for x in edges.get(open_.pop(), ()) if x not in seen]
        seen.update(fresh)
        open_ += fresh
    return seen


def _problems(is_flow: bool, starts_at: str | None, states: list[dict]) -> list[str]:
    """What is wrong with one flow. states: state and edges (place, via, target)."""
    names, found, on, back = {s["state"] for s in states}, [], {}, {}
    if not states:
        found.append((0, "", 0, "", NO_STATES if is_flow else NOT_JSON))
    if is_flow and starts_at not in names:
        found.append((0, "~", 0, "", f'starts_at references unknown state "{"undefined" if starts_at is None else starts_at}"'))
    for s in states:
        for e in s["edges"]:
            if e["target"] in names:
                on.setdefault(s["state"], []).append(e["target"])
                back.setdefault(e["target"], []).append(s["state"])
            else:
                found.append((1, s["state"], e["place"], e["via"], f'State "{s["state"]}": {e["via"]} references unknown state "{e["target"]}"'))
    found += [(2, x, 0, "", f'State "{x}" is never reached') for x in names - _reached([starts_at], on)]
    found += [(3, x, 0, "", f'State "{x}" leads to no end') for x in names - _reached([s["state"] for s in states if not s["edges"]], back)]
    return [p[-1] for p in sorted(found, key=lambda p: (p[0], p[1].encode(), p[2], p[3].encode(), p[4].encode()))]


def flow_graph_problems(flows: DataFrame, flow: str = "flow", raw: str = "raw") -> DataFrame:
    """Flow, problems (empty where there are none). flows: an identifier and the JSON text {starts_at, states}.

    Unknown targets come first, in order of states; what nothing leads to and what leads to no end is looked for as well,
    so that a flow that would never finish is found before it runs. Rows that share an identifier are flows of their own.
    """
    parsed = spread(flows.select(F.col(flow).alias("flow"), F.col(raw).alias("raw"))).select("flow", json_value(F.col("raw")).alias("v"))
    heads = parsed.select("flow", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)).alias("is_flow"), F.try_variant_get("v", "$.starts_at", "string").alias("starts_at"), F.try_variant_get("v", "$.states", "variant").alias("states"))
    rows = heads.select("flow", "is_flow", "starts_at", F.transform(_entries(F.col("states")), lambda e: F.struct(e["key"].alias("state"), _edges(e["value"]).alias("edges"))).alias("states"))

    def run(batches):
        for batch in batches:
            columns = (batch.column(k).to_pylist() for k in (1, 2, 3))
            yield pa.record_batch([batch.column(0), pa.array([_problems(*x) for x in zip(*columns, strict=True)], pa.list_(pa.string()))], names=["flow", "problems"])

    return rows.mapInArrow(run, f"flow {rows.schema['flow'].dataType.simpleString()}, problems array<string>")
