"""Model skeletons of function bodies: Quint modules and Stateright state machines.

Straight-line statements of the entry block become assignments; richer control flow is listed as a graph with a marked
hole for a person to fill.  A function is one row, its text is made where it lies, and only the texts are gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

OPERATORS = {"Add": "+", "Sub": "-", "Mul": "*", "Div": "/", "Rem": "%", "Eq": "==", "Ne": "!=", "Lt": "<", "Le": "<=", "Gt": ">", "Ge": ">="}
QUINT = {"int": "int", "uint": "int", "bool": "bool"}
RUST = {"int": "i64", "uint": "u64", "float": "f64", "bool": "bool"}
HOLE = "AGENT-TODO"


def fn_key(symbol: str) -> str:
    """An identifier made from a symbol id."""
    key = re.sub(r"\W", "_", symbol)
    return f"f_{key}" if not key or key[0].isdigit() else key


def var_name(key: str, local: int) -> str:
    return f"{key}_l{local}"


def role(local: int, args: int) -> str:
    return "return place" if local == 0 else f"param {local}" if local <= args else "temporary"


def constant(value: Any) -> str | None:
    v = value["v"]
    return None if v is None or value["ty"] == "Unknown" else str(v).lower() if value["ty"] == "Bool" else str(v)


def _term(o: Any, name) -> str | None:  # noqa: ANN001
    return name(o["local"]) if o["kind"] == "Local" else constant(o["value"])


def _expression(r: Any, name) -> str | None:  # noqa: ANN001
    if r["op"] == "Use":
        return _term(r["operand"], name)
    if r["op"] == "Unary" and r["kind"] in ("Neg", "Not"):
        t = _term(r["operand"], name)
        return t and ("-" if r["kind"] == "Neg" else "not ") + t
    if r["op"] == "Binary" and r["kind"] in OPERATORS:
        a, b = _term(r["left"], name), _term(r["right"], name)
        return f"{a} {OPERATORS[r['kind']]} {b}" if a and b else None
    return None


def _successors(t: Any) -> str:
    out = [str(t[k]) for k in ("block", "target", "otherwise") if t[k] is not None]
    out += [f"{x['value']}:{x['block']}" for x in t["targets"] or []] + [str(s) for s in t["successors"] or []]
    return f"{t['kind']}" + (f" -> {', '.join(out)}" if out else "")


def straight(body: Any) -> bool:
    return len(body["blocks"]) == 1 and body["blocks"][0]["terminator"]["kind"] == "Return"


def _graph(body: Any, mark: str) -> list[str]:
    return [f"{mark} ---- CFG ({len(body['blocks'])} blocks) ----", *(f"{mark}   b{i}: {_successors(b['terminator'])}" for i, b in enumerate(body["blocks"])), f"{mark} {HOLE}: encode control flow"]


def quint_function(body: Any) -> tuple[str, str]:
    """(variables, action)."""
    key = fn_key(body["id"])
    name = lambda n: var_name(key, n)
    variables = [f"  var {name(i)}: {QUINT.get(x['kind'], 'int')} // {role(i, body['arg_count'])} of {body['display']} ({body['file']}:{body['line']})" + ("" if x["kind"] in QUINT else f" {HOLE}: {x['kind']} has no model type") for i, x in enumerate(body["locals"] or [])]
    lines, assigned = [], set()
    for s in (body["blocks"] or [{"stmts": []}])[0]["stmts"] or []:
        e = _expression(s["rvalue"], name)
        if e is None or s["place"] in assigned:
            lines.append(f"    // {HOLE}: line {s['loc']['line']} sets {name(s['place'])}")
        else:
            assigned.add(s["place"])
            lines.append(f"    {name(s['place'])}' = {e},")
    lines += [f"    {name(i)}' = {name(i)}," for i in range(len(body["locals"] or [])) if i not in assigned]
    if not straight(body):
        lines += ["    " + x for x in _graph(body, "//")]
    return "\n".join(variables), f"  // ---- action {key} (from {body['id']} @ {body['file']}:{body['line']}) ----\n  action {key} = all {{\n" + "\n".join(lines) + "\n  }"


def stateright_function(body: Any) -> tuple[str, str]:
    """(state fields, arm of the step function)."""
    key = fn_key(body["id"])
    name = lambda n: f"state.{var_name(key, n)}"
    fields = [f"    pub {var_name(key, i)}: {RUST.get(x['kind'], 'i64')}, // {role(i, body['arg_count'])} of {body['display']}" for i, x in enumerate(body["locals"] or [])]
    lines = []
    for s in (body["blocks"] or [{"stmts": []}])[0]["stmts"] or []:
        e = _expression(s["rvalue"], name)
        lines.append(f"                {name(s['place'])} = {e.replace('not ', '!')};" if e else f"                // {HOLE}: line {s['loc']['line']} sets {name(s['place'])}")
    if not straight(body):
        lines += ["                " + x for x in _graph(body, "//")]
    return "\n".join(fields), f"            Action::{key} => {{\n" + "\n".join(lines) + "\n            }"


def model_parts(bodies: DataFrame, kind: str = "quint") -> DataFrame:
    """(id, key, variables, action) per function; kind: quint or stateright."""
    make = {"quint": quint_function, "stateright": stateright_function}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(b["id"], fn_key(b["id"]), *make(b)) for b in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [()] * 4)], names=["id", "key", "variables", "action"])

    return bodies.mapInArrow(run, "id string, key string, variables string, action string")


def model_text(bodies: DataFrame, kind: str = "quint") -> str:
    """One model file, functions by id. It is for a person to finish, so its size is that of one project."""
    rows = list(model_parts(bodies, kind).orderBy("id").toLocalIterator())
    head = f"// Lowered from {len(rows)} function bodies. Regions marked GENERATED are made again on each run.\n"
    variables, actions = "\n".join(r["variables"] for r in rows), "\n\n".join(r["action"] for r in rows)
    if kind == "quint":
        choice = "\n".join(f"    {r['key']}," for r in rows)
        return f"{head}module derived {{\n\n  // ---- BEGIN GENERATED: state vars ----\n{variables}\n  // ---- END GENERATED ----\n\n{actions}\n\n  action step = any {{\n{choice}\n  }}\n}}\n"
    arms = "\n".join(f"    {r['key']}," for r in rows)
    return f"{head}#[derive(Clone, Debug, PartialEq)]\npub struct State {{\n{variables}\n}}\n\n#[allow(non_camel_case_types)]\npub enum Action {{\n{arms}\n}}\n\nimpl State {{\n    pub fn step(&self, action: Action) -> State {{\n        let mut state = self.clone();\n        match action {{\n{actions}\n        }}\n        state\n    }}\n}}\n"
