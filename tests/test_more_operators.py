"""Library matches, model skeletons and the edge stream."""

from pyspark.sql import functions as F

from factloom import schemas
from factloom.operators import libraries, models
from factloom.operators.fixpoint import effect_closure
from factloom.plans.range_queries import bodies
from factloom.streaming.edges import EffectStream
from factloom.views import frame
from tests.session import SF

IMPL = lambda name, enum, *traits: (name, "f.rs", 1, 9, enum, 2, [(t, t, None, m, w, 1, 2) for t, m, w in traits])


def test_curated_derives(spark):
    rows = [
        IMPL("MyError", True, ("Display", True, False), ("Error", False, False)), IMPL("Wrapper", False, ("From", False, True)), IMPL("Color", True, ("Display", True, False), ("FromStr", False, False)),
        IMPL("Plain", False, ("From", False, False)), IMPL("Text", False, ("Display", True, False)),
    ]
    table = spark.createDataFrame(rows, schemas.IMPLS)
    got = {(r["symbol_id"], r["library"], r["item"]) for r in libraries.derive_matches(table, {"thiserror": 0.9, "derive_more": 0.8, "strum": 0.8}).collect()}
    assert got == {("MyError", "thiserror", "Error"), ("Wrapper", "derive_more", "From"), ("Color", "derive_more", "Display"), ("Color", "strum", "Display"), ("Color", "strum", "EnumString"), ("Text", "derive_more", "Display")}
    assert libraries.derive_matches(table, {}).isEmpty()


def test_library_findings(spark):
    shape = "arity struct<params:int,results:int,generics:int>, cfg struct<branch_count:int,match_arms:int,loop_count:int,try_count:int,return_points:int,max_nesting:int>, call_sequence array<string>, type_shape struct<params:array<string>,result:string>"
    local = spark.createDataFrame([
        ("gen", "f", (2, 1, 2), (0, 0, 0, 0, 1, 1), [], (["F", "I"], "Result")), ("mono", "f", (2, 1, 0), (0, 0, 0, 0, 1, 1), [], (["F", "I"], "Result")), ("loop", "f", (1, 1, 0), (1, 0, 1, 1, 1, 2), ["next", "push"], (["I"], "Result<Vec>")),
    ], f"symbol_id string, file string, {shape}")
    virtual = spark.createDataFrame([("lib", "try_fold", "rustdoc", "signature", 1.0, (2, 1, 2), (0, 0, 0, 0, 1, 1), [], (["F", "I"], "Result")), ("lib", "collect", "curated", "body", 0.9, (1, 1, 1), (1, 0, 1, 1, 1, 2), ["push"], (["I"], "Result<Vec>"))], f"library string, item string, source string, mode string, trust double, {shape}")
    got = libraries.library_findings(local, spark.createDataFrame([], schemas.IMPLS), virtual, {"itertools": 0.8}).collect()
    assert [(r["id"], r["symbol_id"], r["item"]) for r in got] == [("lib-1", "gen", "try_fold"), ("lib-2", "loop", "collect"), ("lib-3", "loop", "process_results")]
    assert got[0]["confidence"] == 0.9 and got[2]["confidence"] == 0.39


def test_models(spark):
    table = bodies(spark, SF).filter("id IN ('cat::P0', 'cat::P1', 'cat::P2')")
    text = models.model_text(table)
    assert "module derived" in text and "Lowered from 3 function bodies" in text and text.count("action cat__P") == 6 and "// ---- BEGIN GENERATED: state vars ----" in text and "var cat__P0_l1: int" in text
    assert "cat__P0_l0' = cat__P0_l1 / cat__P0_l2," in text and "---- CFG (3 blocks) ----" in text and "SwitchInt" in text and "cat__P1_l3' = cat__P1_l2 == 0," in text
    rust = models.model_text(table, "stateright")
    assert "pub struct State" in rust and "Action::cat__P0 => {" in rust and "state.cat__P0_l0 = state.cat__P0_l1 / state.cat__P0_l2;" in rust


def test_stream_of_edges_reaches_the_same_closure(spark, tmp_path):
    edges, roots = frame(spark, SF, "v_edges"), frame(spark, SF, "v_roots")
    want = {(r["symbol"], r["effect"]) for r in effect_closure(edges, roots).collect()}
    state = EffectStream(roots)
    for i in range(2):
        edges.filter(F.pmod(F.xxhash64("caller", "callee"), F.lit(2)) == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(edges.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = state.start(stream, f"{tmp_path}/checkpoint")
    query.processAllAvailable()
    query.stop()
    assert {(r["symbol"], r["effect"]) for r in state.known.collect()} == want
