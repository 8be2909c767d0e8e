"""Operators of the core against brute force and hand-made cases."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import intervals as I
from factloom.functions import scores
from factloom.functions import symbols as S
from factloom.functions.typestrings import TypeParser
from factloom.operators import components, fixpoint, graph, plan, ranges, similarity

EDGE = "caller string, callee string, kind string, resolution string, evidence_file string, evidence_line int, seam boolean"


def edges(spark, pairs, kind="call"):
    return spark.createDataFrame([(a, b, kind, "call", "f", 1, False) for a, b in pairs] or [], EDGE)


def closure(pairs):
    reach = {}
    for a, b in pairs:
        reach.setdefault(a, set()).add(b)
    changed = True
    while changed:
        changed = False
        for a, bs in reach.items():
            more = set().union(bs, *(reach.get(b, ()) for b in bs))
            changed |= more != bs
            reach[a] = more
    return reach


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(14)]
    pairs = sorted({(r.choice(names), r.choice(names)) for _ in range(22)})
    reach = closure(pairs)
    nodes = spark.createDataFrame([(n,) for n in names], "id string")
    table = edges(spark, pairs)
    comp = {x["id"]: x["component"] for x in graph.strongly_connected(nodes, table).collect()}
    for a in names:
        together = {a} | {b for b in reach.get(a, ()) if a in reach.get(b, ())}
        assert comp[a] == min(together)
    cond = graph.condensation(nodes, table).collect()
    assert sorted(map(str, cond)) == sorted(map(str, graph.condensation(nodes, table, small_edges=0).collect()))
    level = {x["id"]: x["level"] for x in cond}
    assert all(level[a] > level[b] for a, b in pairs if comp[a] != comp[b])
    order = [x["component"] for x in graph.topological_order(graph.condensation(nodes, table)).collect()]
    assert len([k for k, _ in itertools.groupby(order)]) == len(set(order))
    weak = {x["node"]: x["component"] for x in components.connected_components(table, "caller", "callee").collect()}
    assert all(weak[a] == weak[b] for a, b in pairs if a != b) and all(v <= k for k, v in weak.items())
    roots = spark.createDataFrame([("n0", "fs"), ("n1", "net"), ("n1", "fs")], "symbol string, effect string")
    found = {(x["symbol"], x["effect"]): x["path"] for x in fixpoint.effect_closure(table, roots).collect()}
    want = {(s, e) for s, e in [("n0", "fs"), ("n1", "net"), ("n1", "fs")]} | {(a, e) for s, e in [("n0", "fs"), ("n1", "net"), ("n1", "fs")] for a in names if s in reach.get(a, ())}
    assert set(found) == want
    assert all(p[0] == s and (p[-1], e) in {("n0", "fs"), ("n1", "net"), ("n1", "fs")} and all(step in set(pairs) for step in zip(p, p[1:])) for (s, e), p in found.items())
    counts = {x["id"]: x["transitive_dep_count"] for x in graph.transitive_counts(graph.dependency_pairs(table)).collect()}
    assert counts == {a: len(bs - {a}) for a, bs in closure([p for p in pairs if p[0] != p[1]]).items() if bs - {a}}


def test_type_edges_carry_no_effects(spark):
    table = edges(spark, [("a", "b")]).unionByName(edges(spark, [("c", "b")], "type"))
    roots = spark.createDataFrame([("b", "fs")], "symbol string, effect string")
    assert {x["symbol"] for x in fixpoint.effect_closure(table, roots).collect()} == {"a", "b"}


def test_shortest_evidence(spark):
    table = edges(spark, [("3", "4"), ("2", "4"), ("1", "0"), ("3", "1")])
    roots = spark.createDataFrame([("0", "b"), ("1", "a"), ("4", "b")], "symbol string, effect string")
    assert {(x["symbol"], x["effect"]): x["path"] for x in fixpoint.effect_closure(table, roots).collect()}["3", "b"] == ["3", "4"]


def test_rounds_are_never_cut_short(spark):
    with pytest.raises(RuntimeError):
        fixpoint.reach(edges(spark, [("a", "b"), ("b", "c"), ("c", "d")]), spark.createDataFrame([("a",)], "id string"), max_rounds=2)


def test_layers_of_a_cycle(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    assert graph.layers(nodes, edges(spark, [("a", "b"), ("b", "a")])) is None
    assert {x["id"]: x["wave"] for x in graph.layers(nodes, edges(spark, [("a", "b")])).collect()} == {"b": 0, "a": 1}


def acyclic(groups, deps):
    of = {p: i for i, g in enumerate(groups) for p in g}
    reach = closure([(of[a], of[b]) for a, b in deps if of[a] != of[b]])
    return all(a not in bs for a, bs in reach.items())


def greedy(files, deps, limit):
    groups = [{f} for f in files]
    size = lambda g: sum(files[f] for f in g)
    while True:
        of = {p: i for i, g in enumerate(groups) for p in g}
        near = {i: {of[b] for a, b in deps if of[a] == i} | {of[a] for a, b in deps if of[b] == i} for i in range(len(groups))}
        pick = None
        for i in sorted((i for i in near if size(groups[i]) < limit), key=lambda i: min(groups[i])):
            for j in sorted(near[i] - {i}, key=lambda j: min(groups[j])):
                merged = [g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] | groups[j]]
                if size(groups[i] | groups[j]) < limit and acyclic(merged, deps):
                    pick = merged
                    break
            if pick:
                break
        if not pick:
            return {f: min(g) for g in groups for f in g}
        groups = pick


@pytest.mark.parametrize("seed", range(8))
def test_coalescing_follows_the_greedy_order(seed):
    r = random.Random(seed)
    files = {f"f{i:02}": r.randint(5, 60) for i in range(12)}
    names = sorted(files)
    deps = sorted({tuple(sorted(r.sample(names, 2), reverse=True)) for _ in range(16)})
    assert plan.coalesce_small([(f, f, False, n) for f, n in files.items()], deps, 100) == greedy(files, deps, 100)


def test_symbol_functions(spark):
    rows = spark.createDataFrame([("std::vec::Vec::<T>::push",), ("<app::X as std::fmt::Display>::fmt",), ("<&mut std::io::Stdout as W>::write",), ("a<b<c>",), ("x::f<fn(A) -> B>::g",), ("plain",), ("a" + "<q" * 40 + ">" * 40 + "::b",), ("a<b::c",), ("a>b",)], "s string")
    got = rows.select(S.strip_generics(F.col("s")), S.leading_crate(F.col("s")), S.trusted_pure(F.col("s")), S.package_of(F.col("s")), S.leaf_name(F.col("s")), F.array_sort(S.segment_runs(F.lit("a::b::c")))).collect()
    assert [r[0] for r in got][:4] == ["std::vec::Vec::push", "::fmt", "::write", "a"] and [r[0] for r in got][6:] == ["a::b", "a", "a>b"] and [r[1] for r in got][:6] == ["std", "app", "std", None, "x", None]
    assert [r[2] for r in got][:6] == [True, True, True, False, False, False] and got[0][5] == ["a", "a::b", "a::b::c", "b", "b::c", "c"]
    assert spark.range(1).select(S.round_half_away(F.lit(1.004), 2), S.round_half_away(F.lit(-0.125), 2)).first()[:] == (1.0, -0.13)


@pytest.mark.parametrize(("glob", "yes", "no"), [("src/**", ["src/a/b.rs"], ["srcs/a"]), ("src/*.rs", ["src/a/b.rs"], ["src/a.ts"]), ("**/x", ["x", "a/b/x"], ["ax"]), ("a?c[0-9]", ["abc1"], ["abc"])])
def test_globs(glob, yes, no):
    import re

    assert all(re.match(S.glob_to_regex(glob), x) for x in yes) and not any(re.match(S.glob_to_regex(glob), x) for x in no)


def test_hashes():
    seeds = scores.splitmix_seeds()
    assert [hex(int(s)) for s in seeds[:2]] == ["0x6e789e6aa1b965f4", "0x6c45d188009454f"]
    assert scores.fnv1a_bytes(b"") == 0xCBF29CE484222325 and scores.fnv1a_bytes(b"a") == 0xAF63DC4C8601EC8C
    assert scores.fnv1a_rows(np.frombuffer(b"ab", np.uint8).reshape(2, 1)).tolist() == [scores.fnv1a_bytes(b"a"), scores.fnv1a_bytes(b"b")]
    a, b = np.arange(100, dtype=np.int64), np.arange(10, 110, dtype=np.int64)
    assert abs(float(np.mean(scores.minhash(a, seeds) == scores.minhash(b, seeds))) - 90 / 110) < 0.2
    assert scores.word_shingles(["x", "y"]) == scores.word_shingles(["x", "y"]) != scores.word_shingles(["y", "x"]) and len(scores.word_shingles(list("abcde"))) == 3 and scores.word_shingles([]) == []


def test_refining_clusters():
    tight = [("a", "b", 0.9), ("a", "c", 0.9), ("b", "c", 0.9)]
    assert similarity.refine(list("abc"), tight, 0.7) == ([["a", "b", "c"]], 0)
    chain = tight + [("c", "d", 0.6), ("d", "e", 0.9)]
    assert sorted(similarity.refine(list("abcde"), chain, 0.7)[0]) == [["a", "b", "c"], ["d", "e"]]
    assert similarity.refine(list("abcd"), [("a", "b", 0.8), ("b", "c", 0.8), ("c", "d", 0.8)], 0.75) == ([], 1)


def test_similarity_end_to_end(spark):
    schema = "symbol_id string, language string, file string, arity struct<params:int,results:int,generics:int>, cfg struct<branch_count:int,match_arms:int,loop_count:int,try_count:int,return_points:int,max_nesting:int>, stmt_histogram map<string,int>, call_sequence array<string>, type_shape struct<params:array<string>,result:string>, shingles array<bigint>, token_len int, features map<string,string>"
    one = lambda i, calls, types, lang="rust": (i, lang, "f.rs", (1, 1, 0), (1, 0, 0, 1, 1, 1), {"let": 2, "if": 1}, calls, ([types], "R"), [1, 2, 3, 4], 30, {})
    rows = [one("parse_u8", ["a", "b"], "T1"), one("parse_u16", ["a", "b"], "T2"), one("other", ["a", "b"], "T1", "typescript"), ("tiny", *one("t", [], "x")[1:9], 3, {})]
    found, stats = similarity.analyze(spark.createDataFrame(rows, schema))
    (f,) = found.collect()
    assert f["members"] == ["parse_u16", "parse_u8"] and f["family"] == "generic_function" and f["confidence"] <= 0.85 and f["id"] == "cand-1"
    assert stats.first()["signatures_after_filter"] == 3 and stats.first()["pairs_compared"] == 1


def holds(v: I.Interval, x: float) -> bool:
    return (v.may_be_nan if x != x else v.lower <= x <= v.upper and v.excluded != x) and (not v.integer or x == int(x))


@pytest.mark.parametrize("seed", range(200))
def test_interval_arithmetic_covers_all_values(seed):
    r = random.Random(seed)
    make = lambda: (lambda a, b: I.Interval(float(min(a, b)), float(max(a, b)), True, False, 0.0 if min(a, b) < 0 < max(a, b) and r.random() < 0.5 else None))(r.randint(-6, 6), r.randint(-6, 6))
    a, b = make(), make()
    for x, y in itertools.product(range(int(a.lower), int(a.upper) + 1), range(int(b.lower), int(b.upper) + 1)):
        if not (holds(a, x) and holds(b, y)):
            continue
        assert holds(I.add(a, b), x + y) and holds(I.sub(a, b), x - y) and holds(I.mul(a, b), x * y) and holds(I.join(a, b), x) and holds(-a, -x)
        assert holds(I.widen(a, I.join(a, b)), x)
        if y:
            q = abs(x) // abs(y) * (1 if x * y >= 0 else -1)
            assert holds(I.integer_div(a, b), q) and holds(I.rem(a, b), x - q * y) and holds(I.div(a, b), x / y)


def test_interval_texts():
    assert [I.describe(v) for v in (I.UNKNOWN, I.ANY_INTEGER, I.FINITE, I.Interval(1.0, 2.5), I.Interval(-3.0, 3.0, True, False, 0.0))] == ["unknown", "integer (any)", "in [-max, max]", "in [1, 2.5]", "integer in [-3, 3] excluding 0"]
    assert I.next_up(0.0) == 5e-324 and I.next_down(1.0) < 1


def test_loop_and_call_bodies():
    local, const = lambda n: {"kind": "Local", "local": n, "value": None}, lambda v: {"kind": "Const", "local": None, "value": {"ty": "Int", "v": str(v)}}
    stmt = lambda p, op, a, b=None: {"place": p, "rvalue": {"op": "Binary" if b else "Use", "kind": op, "operand": a, "left": a, "right": b}, "loc": {"file": "f", "line": p, "col": 1}}
    end = lambda **k: {"kind": None, "block": None, "target": None, "discr": None, "targets": None, "otherwise": None, "destination": None, "successors": None, **k}
    body = {
        "arg_count": 1, "locals": [{"kind": "int"}] * 4,
        "blocks": [
            {"stmts": [stmt(2, "Use", const(1))], "terminator": end(kind="Goto", block=1)},
            {"stmts": [stmt(3, "Lt", local(2), const(10))], "terminator": end(kind="SwitchInt", discr=local(3), targets=[{"value": 0, "block": 3}], otherwise=2)},
            {"stmts": [stmt(2, "Add", local(2), const(1))], "terminator": end(kind="Goto", block=1)},
            {"stmts": [stmt(0, "Div", local(1), local(2))], "terminator": end(kind="Call", target=4, destination=2)},
            {"stmts": [stmt(0, "Rem", local(1), local(2))], "terminator": end(kind="Return")},
        ],
    }
    params, returned, hazards = ranges.analyze_body(body)
    assert [I.describe(p) for p in params] == ["integer (any)"] and [(k, loc["line"]) for k, loc, _ in hazards] == []
    body["blocks"][0]["stmts"] = [stmt(2, "Use", const(-1))]
    assert [k for k, _, _ in ranges.analyze_body(body)[2]] == []
    body["blocks"][1]["terminator"] = end(kind="Other", successors=[2, 3])
    assert [k for k, _, _ in ranges.analyze_body(body)[2]] == ["divide-by-zero"]


def test_type_strings():
    p = TypeParser(enums={"Mode"}, models={"User"}, declared={"Hidden"}, interfaces={"Client"})
    assert p.parse("Array<{ id: number; name?: string }>")[0] == {"list": {"model": "Object"}} and p.minted["Object"]["fields"][1] == {"name": "name", "type": "string", "nullable": True}
    assert p.parse("{ id: number, name?: string }")[0] == {"model": "Object"}
    assert p.parse("User | Mode | null")[0] == {"nullable": {"union": "UserOrModeUnion"}} and [v["tag"] for v in p.unions["UserOrModeUnion"]] == ["user", "mode"]
    assert p.parse("Client")[0] == {"model": "Client"} and p.parse("Error")[0] == {"model": "JsError"}
    assert p.parse("Hidden") == ("Json", True) and not p.missing and p.parse("Absent") == ("Json", True) and p.missing == {"Absent": 1}
    assert p.parse("{ close(): void; get(id: string): Promise<User> }")[0] == {"model": "Handle"} and [o["name"] for o in p.minted_interfaces["Handle"]] == ["close", "get"]
    assert p.parse("(x: number) => string") == ("Json", True) and p.reasons["non-void callback"] == 1
    assert p.parse("/* c */ 'a|b' // d\n | \"x\"")[0] == "string"


def test_near_misses(spark):
    rows = spark.createDataFrame([("a::Parse", "Parse", False), ("b::x", "reparse_all", False), ("c::y", None, False), ("d::z", "z", True)], "id string, display string, external boolean")
    near = lambda p, n=5: [r[0] for r in graph.near_misses(rows, p, n).collect()]
    assert near("PARSE") == ["a::Parse", "b::x"] and near("parsers") == ["a::Parse", "b::x", "c::y"] and near("parsers", 1) == ["a::Parse"]


def test_long_chains_end(spark, monkeypatch):
    """Tables of rounds are merged in levels and lose nothing; a chain of 40,000 condenses in linear time."""
    monkeypatch.setattr(fixpoint, "MERGE", 2)
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(13)]
    got = fixpoint.reach(edges(spark, chain), spark.createDataFrame([("n000",)], "id string")).collect()
    assert {r["id"]: r["hops"] for r in got} == {f"n{i:03}": i for i in range(14)}
    long = graph.condense_local([(i, i + 1) for i in range(40_000)])
    assert len(long) == 40_001 and max(level for *_, level in long) == 40_000


def test_similar_pairs_need_no_common_key(spark):
    """Two functions on either side of a size band are similar, and copies are listed once each."""
    schema = "symbol_id string, language string, file string, arity struct<params:int,results:int,generics:int>, cfg struct<branch_count:int,match_arms:int,loop_count:int,try_count:int,return_points:int,max_nesting:int>, stmt_histogram map<string,int>, call_sequence array<string>, type_shape struct<params:array<string>,result:string>, shingles array<bigint>, token_len int, features map<string,string>"
    one = lambda i, tokens, calls=("a", "b", "c"), lang="rust": (i, lang, "f.rs", (1, 1, 0), (2, 0, 0, 1, 1, 1), {"let": 2, "if": 1}, list(calls), (["T"], "R"), [1, 2, 3, 4], tokens, {})
    rows = [one("p", 39), one("q", 40), one("q2", 40), one("other", 40, lang="go"), one("r", 40, ("x",))]
    table = spark.createDataFrame(rows, schema)
    assert similarity.candidate_pairs(table, lsh=False).filter("a = 'p' OR b = 'p'").isEmpty()
    got = {tuple(r) for r in similarity.similar(table, 0.9).collect()}
    assert got == {("p", "q", "pair"), ("q", "q2", "copy")}
    pairs = table.select(F.col("symbol_id").alias("a")).crossJoin(table.filter("language = 'rust'").select(F.col("symbol_id").alias("b"))).filter("a < b AND a <> 'other'")
    want = {(r["a"], r["b"]): r["aggregate"] for r in similarity.score_pairs(table, pairs).collect()}
    for rows_ in (1, 500):
        assert {(r["a"], r["b"]): r["aggregate"] for r in similarity.all_pairs(table, 0.0, rows_).collect()} == want


def test_copies_are_scored_once(spark):
    """Forty copies of two functions: one pair and two classes are scored, and count as 780 + 780 + 1,600."""
    schema = "symbol_id string, language string, file string, arity struct<params:int,results:int,generics:int>, cfg struct<branch_count:int,match_arms:int,loop_count:int,try_count:int,return_points:int,max_nesting:int>, stmt_histogram map<string,int>, call_sequence array<string>, type_shape struct<params:array<string>,result:string>, shingles array<bigint>, token_len int, features map<string,string>"
    one = lambda i, t: (i, "rust", "f.rs", (1, 1, 0), (1, 0, 0, 1, 1, 1), {"let": 2, "if": 1}, ["a", "b"], ([t], "R"), [1, 2, 3, 4], 30, {})
    table = spark.createDataFrame([one(f"{t}{i:02}", t) for t in "xy" for i in range(40)], schema)
    scored, of = similarity.class_pairs(table, 0.0)
    assert {(r["a"], r["b"]): r["weight"] for r in scored.collect()} == {("x00", "y00"): 1600, ("x00", "x00"): 780, ("y00", "y00"): 780}
    got = {(r["a"], r["b"]): round(r["aggregate"], 9) for r in similarity.member_pairs(scored, of).collect()}
    want = {(r["a"], r["b"]): round(r["aggregate"], 9) for r in similarity.score_pairs(table, similarity.candidate_pairs(table)).collect()}
    assert got == want and len(got) == 3160
    found, stats = similarity.analyze(table)
    assert stats.first()["pairs_compared"] == 3160 and [r["size"] for r in found.collect()] == [80]
