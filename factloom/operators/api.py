"""Public-API records: a stable order, and conversion into structured types per package.

Packages are independent, and inside one the names given to unions and inline objects depend on what came before; so a
package is one group and the conversion runs per group (`applyInArrow`).
"""

from __future__ import annotations

import json
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.typestrings import UNTYPED, TypeParser, alias_members, const_value, literal_union, normalize, operation, pascal, peel, top_arrow


def normalize_reports(reports: DataFrame) -> DataFrame:
    """Reports with modules sorted by path and items by (kind, name); fields, parameters and variants keep their order."""

    def before(key):  # noqa: ANN001
        return lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)

    # Rows that compare equal keep their order: their place is part of the key.
    placed = F.transform("modules", lambda m: m.withField("items", F.transform(F.array_sort(F.transform(m["items"], lambda x, i: F.struct(x["kind"].alias("k"), x["name"].alias("n"), i.alias("i"), x.alias("x"))), before(lambda s: F.struct(s["k"], s["n"], s["i"]))), lambda s: s["x"])))
    by_path = F.transform(F.array_sort(F.transform(placed, lambda m, i: F.struct(m["path"].alias("p"), i.alias("i"), m.alias("m"))), before(lambda s: F.struct(s["p"], s["i"]))), lambda s: s["m"])
    return reports.withColumn("modules", by_path)


def api_items(reports: DataFrame) -> DataFrame:
    """One row per item: package, module and the item's columns."""
    return reports.select(F.col("package.name").alias("package"), F.explode("modules").alias("m")).select("package", F.col("m.path").alias("module"), F.explode("m.items").alias("i")).select("package", "module", "i.*")


def public_items(items: DataFrame, exported: DataFrame | None = None) -> DataFrame:
    """The Python surface: names that the module exports if it says so (exported(module, name)), else those without a leading underscore."""
    if exported is None:
        return items.filter(~F.startswith("name", F.lit("_")))
    said = exported.select("module").distinct().withColumn("says", F.lit(True))
    listed = exported.select("module", "name").distinct().withColumn("listed", F.lit(True))
    met = items.join(said, "module", "left").join(listed, ["module", "name"], "left")
    return met.filter(F.when(F.col("says"), F.col("listed")).otherwise(~F.startswith("name", F.lit("_")))).select(*items.columns)


def _params(item: dict) -> list[tuple[str, str, bool]]:
    return [(p["name"] or "", p["ty"], bool(p["optional"])) for p in (item["signature"] or {}).get("params") or []]


def _belongs(method: dict, cls: dict) -> bool:
    return (method["signature"] or {}).get("receiver") == cls["name"] or (method["id"] or "").startswith(f"{cls['id']}.")


def _models_in(t: Any, out: set[str]) -> None:
    if isinstance(t, dict):
        if "model" in t:
            out.add(t["model"])
        for k in ("list", "nullable"):
            if k in t:
                _models_in(t[k], out)
        for p in t.get("callback", {}).get("params", []):
            _models_in(p, out)


def convert(items: list[dict], package: str, context: list[dict] = ()) -> dict:
    """Structured surface of a package: enums, models, unions, interfaces, consts, and what was degraded and why."""
    of = lambda *kinds: [i for i in items if i["kind"] in kinds]
    enums = {i["name"]: [{"name": v["name"], "value": v["discriminant"]} for v in i["variants"] or []] for i in [*of("enum"), *[c for c in context if c["kind"] == "enum"]]}
    for i in of("typeAlias"):
        if names := literal_union(i["aliasTarget"]):
            enums.setdefault(i["name"], [{"name": n, "value": None} for n in names])
    records = of("interface", "record", "struct")
    classes = [c for c in of("class") if any(_belongs(m, c) for m in of("method"))]
    fields = {i["name"]: [f["ty"] for f in i["fields"] or []] for i in records}
    parser = TypeParser(enums=set(enums), models=set(fields) | {c["name"] for c in context if c["kind"] in ("interface", "record", "struct")}, interfaces={c["name"] for c in classes}, declared={i["name"] for i in items})
    lifted = {i["name"]: m for i in of("typeAlias") if i["name"] not in enums and (m := alias_members(i["aliasTarget"], fields))}
    parser.unions.update({n: [] for n in lifted})
    for name, members in lifted.items():
        del parser.unions[name]
        parser.lift_union(name, members)
    stats = dict.fromkeys(("ops_clean", "ops_degraded", "fields_total", "fields_degraded", "consts", "dropped"), 0)
    waiting: list[tuple[str, dict, bool, bool]] = []

    def ops(owner: str, functions: list[dict]) -> list[dict]:
        out = []
        for f in functions:
            parser.generics = set(f["generics"] or []) | set((f["signature"] or {}).get("generics") or [])
            parser.hint = [owner + pascal(f["name"])]
            result = (f["signature"] or {}).get("returnType")
            if top_arrow(normalize(result)) >= 0 and normalize(result).endswith("=> void"):  # registers a listener, returns its removal
                op, bad = operation(parser, f["name"], _params(f), None, bool((f["signature"] or {}).get("isAsync")))
                calls = sum(isinstance(p["type"], dict) and "callback" in p["type"] for p in op["params"])
                waiting.append((owner, op, calls == 1, bad))
            else:
                op, bad = operation(parser, f["name"], _params(f), result, bool((f["signature"] or {}).get("isAsync")))
                stats["ops_degraded" if bad else "ops_clean"] += 1
            out.append(op)
        parser.hint, parser.generics = [], set()
        return sorted(out, key=lambda o: o["name"])

    interfaces = {}
    if free := of("function"):
        interfaces[pascal(package.rsplit("/", 1)[-1].lstrip("@")) or "Api"] = ops("", free)
    for c in classes:
        interfaces[c["name"]] = ops(c["name"], [m for m in of("method") if _belongs(m, c)])
    models = {}
    for i in records:
        parser.generics, out = set(i["generics"] or []), []
        for f in i["fields"] or []:
            if top_arrow(normalize(f["ty"])) >= 0:
                parser.notes["method field skipped"] += 1
                continue
            stats["fields_total"] += 1
            parser.hint = [pascal(i["name"]) + pascal(f["name"])]
            t, bad = parser.parse(f["ty"])
            t, was = peel(t)
            stats["fields_degraded"] += bad
            out.append({"name": f["name"], "type": t, "nullable": bool(f["optional"]) or was})
        models[i["name"]] = out
        parser.generics, parser.hint = set(), []
    consts = {}
    for i in of("const"):
        if normalize(i["constType"]) in UNTYPED:
            stats["dropped"] += 1
            continue
        t, _ = parser.parse(i["constType"])
        consts[i["name"]] = {"type": t, "value": const_value(t, i["constValue"])}
        stats["consts"] += 1
    interfaces |= parser.minted_interfaces
    models |= {n: m["fields"] for n, m in parser.minted.items()}
    referenced: set[str] = set()
    for t in [*(o["returns"] for os in interfaces.values() for o in os), *(p["type"] for os in interfaces.values() for o in os for p in o["params"]), *(f["type"] for fs in models.values() for f in fs), *(c["type"] for c in consts.values())]:
        _models_in(t, referenced)
    for owner, op, single, bad in waiting:
        if single and owner in referenced:
            op["shape"] = "subscription"
            stats["ops_degraded" if bad else "ops_clean"] += 1
        else:
            op["returns"] = parser.degrade("subscription without a constructible owner")[0]
            stats["ops_degraded"] += 1
    return {
        "enums": enums, "models": models, "unions": parser.unions, "interfaces": interfaces, "consts": consts, "stats": stats, "reasons": dict(parser.reasons), "notes": dict(parser.notes),
        "missing": dict(parser.missing), "foreign": dict(parser.foreign),
    }


def context_closure(items: list[dict], others: dict[str, list[dict]]) -> list[dict]:
    """Items of other packages that the types of `items` name, and what those name, until nothing new is needed."""
    at = {i["name"]: i for rows in others.values() for i in rows}
    need, found, todo = set(), [], list(items)
    while todo:
        i = todo.pop()
        text = " ".join([f["ty"] or "" for f in i["fields"] or []] + [p["ty"] or "" for p in (i["signature"] or {}).get("params") or []] + [(i["signature"] or {}).get("returnType") or "", i["aliasTarget"] or "", i["constType"] or ""])
        for name in set(re.findall(r"[A-Za-z_$][\w$]*", text)) & at.keys() - need:
            need.add(name)
            found.append(at[name])
            todo.append(at[name])
    return sorted(found, key=lambda i: i["name"])


def structured_surface(items: DataFrame) -> DataFrame:
    """(package, section, name, body): one row per enum, model, union, interface and const; body is JSON."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["module"], r["kind"], r["name"], r["id"] or ""))
        done = convert(rows, key[0].as_py())
        out = [(key[0].as_py(), section, name, json.dumps(body, sort_keys=True)) for section in ("enums", "models", "unions", "interfaces", "consts", "stats", "reasons", "notes", "missing", "foreign") for name, body in sorted(done[section].items())]
        columns = list(zip(*out)) or [()] * 4
        return pa.table({n: pa.array(c, pa.string()) for n, c in zip(("package", "section", "name", "body"), columns)})

    return items.groupBy("package").applyInArrow(run, "package string, section string, name string, body string")


def coverage(surface: DataFrame) -> DataFrame:
    """(package, reasons): how often each reason degraded a type."""
    rows = surface.filter("section = 'reasons'").select("package", "name", F.col("body").cast("int").alias("n"))
    return rows.groupBy("package").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("reasons"))
