"""How much the steps shuffle and keep: small tables on which a step that sends too much is seen at once."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import views
from factloom.operators import fixpoint, graph, reachability
from tests.session import SF


def shuffled(spark: SparkSession, run) -> tuple:
    """(result of run, rows written to shuffles meanwhile)."""
    sc = spark.sparkContext
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in iterate(sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None))}
    before = max(stages(), default=-1)
    out = run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return out, sum(n for i, n in stages().items() if i > before)


def iterate(seq):
    at = seq.iterator()
    while at.hasNext():
        yield at.next()


def edges(spark: SparkSession, pairs: list[tuple[str, str]], kind: str = "call") -> DataFrame:
    return spark.createDataFrame([(a, b, kind, "call") for a, b in pairs], "caller string, callee string, kind string, resolution string").repartition(4, "callee")


def test_effects_share_the_row_of_an_edge(spark):
    """Eight effects over 4,400 edges in two layers: a row carries all of them."""
    low, high, names = [f"l{i:03}" for i in range(20)], [f"h{i:03}" for i in range(200)], [f"e{i}" for i in range(8)]
    table = edges(spark, [*itertools.product(high, low), *itertools.product(["t1", "t2"], high)])
    roots = spark.createDataFrame([(x, e) for x in low for e in names], "symbol string, effect string")
    got, rows = shuffled(spark, lambda: {(r["symbol"], r["effect"]): r["path"] for r in fixpoint.effect_closure(table, roots).collect()})
    assert got == {(x, e): [x] for x in low for e in names} | {(x, e): [x, "l000"] for x in high for e in names} | {(x, e): [x, "h000", "l000"] for x in ("t1", "t2") for e in names}
    assert rows < 9000, rows


def test_more_effects_than_a_mask_has_bits(spark):
    names = [f"e{i:03}" for i in range(62)]
    roots = spark.createDataFrame([("r", e) for e in names], "symbol string, effect string")
    got = fixpoint.effect_closure(edges(spark, [("a", "r"), ("b", "a"), ("r", "b")]), roots)
    assert {(r["symbol"], r["effect"], *r["path"]) for r in got.collect()} == {x for e in names for x in (("r", e, "r"), ("a", e, "a", "r"), ("b", e, "b", "a", "r"))}
    bare = fixpoint.effect_closure(edges(spark, [("a", "r")]), roots, paths=False)
    assert bare.columns == ["symbol", "effect"] and bare.count() == 124


def test_large_condensations_take_the_same_levels(spark):
    """A cycle amid a chain, over few edges a task; before, no part of it was found in bins."""
    pairs = [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "e"), ("x", "a"), ("y", "x"), ("e", "f"), ("b", "f")]
    nodes, table = spark.createDataFrame([(n,) for n in "abcdefxyz"], "id string"), edges(spark, pairs)
    want = sorted(map(str, graph.condensation(nodes, table).collect()))
    assert sorted(map(str, graph.condensation(nodes, table, small_edges=3).collect())) == want
    found = graph._cycles(spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 3), (5, 1)], "a long, b long"), 2)
    assert {tuple(r) for r in found.collect()} == {(1, 1), (2, 1), (3, 3), (4, 3)}


def test_file_rollup_needs_no_cycles(spark):
    defs = spark.createDataFrame([("a", "a", "f", 1, 3), ("b", "b", "f", 5, 4), ("c", "c", "g", 1, 1)], "id string, display string, file string, line_start int, line_end int").withColumn("language", F.lit("rust"))
    table = edges(spark, [("a", "b"), ("b", "a"), ("a", "ext::x"), ("c", "lib::y"), ("c", "c")])
    effects = spark.createDataFrame([("a", "fs"), ("b", "net")], "symbol string, effect string")
    got = graph.file_rollup(graph.symbol_sets(defs, table, effects)).collect()
    assert sorted(map(str, got)) == sorted(map(str, graph.file_rollup(graph.symbol_table(defs, table, effects)).collect()))


def test_reachable_nodes_are_counted_without_their_pairs(spark):
    tops, mids, lows = [f"t{i:03}" for i in range(100)], [f"m{i:03}" for i in range(20)], [f"l{i:03}" for i in range(200)]
    table = edges(spark, [*((t, m) for t in tops for m in mids[:2]), *((m, x) for m in mids for x in lows), ("m001", "m002"), ("m002", "m001")])
    got, rows = shuffled(spark, lambda: {r[0]: r[1] for r in graph.transitive_counts(table).collect()})
    assert got == {t: 203 for t in tops} | {m: 201 if m in ("m001", "m002") else 200 for m in mids}
    assert rows < 40000, rows


@pytest.mark.parametrize("size", [5, 5000])
def test_unions_of_sets(size):
    """Sparse and dense sets, cut into batches at any place."""
    r = random.Random(size)
    parts = sorted((r.randint(0, 2), r.randint(0, 1), i) for i in range(30))
    sets = [r.sample(range(1 << 16), r.randint(1, size)) for _ in parts]
    want: dict = {}
    for (c, block, _), s in zip(parts, sets):
        want.setdefault((c, block), set()).update(s)
    low = [s[0] if len(s) == 1 else None for s in sets]
    els = pa.array([None if len(s) == 1 else reachability._encode(np.sort(np.array(s)), np.array([len(s)]))[0].as_py() for s in sets], pa.binary())
    table = pa.table({"c": pa.array([p[0] for p in parts], pa.int64()), "block": pa.array([p[1] for p in parts], pa.int32()), "els": els, "low": pa.array(low, pa.int32())})
    got: dict = {}
    for batch in reachability.unite(b for b in table.to_batches(max_chunksize=4)):
        row, found = reachability._decode(batch.column(2))
        for i, (c, block, k) in enumerate(zip(*(batch.column(j).to_pylist() for j in (0, 1, 3)))):
            assert (c, block) not in got and k == (row == i).sum()
            got[c, block] = set(found[row == i].tolist())
    assert got == want


def test_edges_are_made_distinct_on_their_keys(spark):
    """The same rows as by the text of the view."""
    text = views.VIEWS["v_edges"]
    want = spark.sql(text, **{t: spark.read.parquet(f"{SF}/{t}.parquet") for t in views.TABLES if "{" + t + "}" in text})
    got = views.frame(spark, SF, "v_edges")
    assert got.schema == want.schema and got.count() == want.count() and got.exceptAll(want).isEmpty()
