"""Local code that a trusted library already offers: signature matches and curated patterns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from factloom.functions.scores import call_sequence_similarity, cfg_similarity, type_shape_similarity
from factloom.functions.symbols import round_half_away

FIDELITY = {"rustdoc": 0.9, "curated": 0.7}
MIN_MATCH = 0.7
CAP = 0.95
ACCUMULATORS = ("push", "insert", "extend", "push_str")


def arity_similarity(a: Column, b: Column) -> Column:
    gap = F.abs(a["params"] - b["params"]) + F.abs(a["generics"] - b["generics"])
    return F.greatest(F.lit(0.0), 1 - gap / 6)


def confidence(trust: Column, structural: Column, source: Column) -> Column:
    fidelity = F.when(source == "rustdoc", FIDELITY["rustdoc"]).otherwise(FIDELITY["curated"])
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return round_half_away(F.least(unit(trust) * unit(structural) * fidelity, F.lit(CAP)), 2)


def signature_matches(local: DataFrame, virtual: DataFrame, min_match: float = MIN_MATCH) -> DataFrame:
    """Local signatures against library(library, item, source, mode, trust, arity, cfg, call_sequence, type_shape).

    'signature' mode: equal results (an equi-join), a generic item only for generic code, 0.7 types + 0.3 arity.
    'body' mode: a loop with a fallible step and one of the item's calls, 0.4 control flow + 0.3 calls + 0.3 types.
    The library side is configuration and is broadcast.
    """
    a = local.select("symbol_id", "file", F.struct("arity", "cfg", "call_sequence", "type_shape").alias("a"))
    b = virtual.select("library", "item", "source", "mode", "trust", F.struct("arity", "cfg", "call_sequence", "type_shape").alias("b"))
    x, y = F.col("a"), F.col("b")
    by_result = a.join(F.broadcast(b.filter("mode = 'signature'")), x["type_shape"]["result"] == y["type_shape"]["result"])
    by_result = by_result.filter(~((y["arity"]["generics"] >= 2) & (x["arity"]["generics"] == 0)))
    by_result = by_result.withColumn("structural", 0.7 * type_shape_similarity(x["type_shape"], y["type_shape"]) + 0.3 * arity_similarity(x["arity"], y["arity"]))
    loops = a.filter((x["cfg"]["loop_count"] > 0) & (x["cfg"]["try_count"] > 0))
    by_body = loops.join(F.broadcast(b.filter("mode = 'body'")), F.arrays_overlap(x["call_sequence"], y["call_sequence"]))
    shape = 0.4 * cfg_similarity(x["cfg"], y["cfg"]) + 0.3 * type_shape_similarity(x["type_shape"], y["type_shape"])
    by_body = by_body.withColumn("calls", call_sequence_similarity(x["call_sequence"], y["call_sequence"])).withColumn("structural", shape + 0.3 * F.col("calls")).drop("calls")
    met = by_result.unionByName(by_body).filter(F.col("structural") >= min_match)
    differs = F.filter(F.array(F.when(x["type_shape"]["result"] != y["type_shape"]["result"], F.lit("result shape")), F.when(x["arity"]["params"] != y["arity"]["params"], F.lit("parameter count"))), lambda d: d.isNotNull())
    return met.select("symbol_id", "library", "item", "source", "trust", "structural", differs.alias("differences"))


def _has(name: str) -> Column:
    return F.exists("traits", lambda t: t["trait_name"] == name)


#: (library, item) -> (structural weight, predicate over impl facts)
DERIVES = {
    ("thiserror", "Error"): (0.9, lambda: _has("Display") & _has("Error")),
    ("derive_more", "From"): (0.85, lambda: F.exists("traits", lambda t: (t["trait_name"] == "From") & t["is_wrapping"])),
    ("derive_more", "Display"): (0.8, lambda: F.exists("traits", lambda t: (t["trait_name"] == "Display") & t["body_is_match_self"]) & ~_has("Error")),
    ("strum", "Display"): (0.75, lambda: F.col("is_enum") & F.exists("traits", lambda t: (t["trait_name"] == "Display") & t["body_is_match_self"]) & ~_has("Error")),
    ("strum", "EnumString"): (0.75, lambda: F.col("is_enum") & _has("FromStr")),
}


def derive_matches(impls: DataFrame, trust: Mapping[str, float]) -> DataFrame:
    """Types whose hand-written impls a derive of a trusted library would generate. One pass over the types."""
    hits = [F.when(rule(), F.struct(F.lit(lib).alias("library"), F.lit(item).alias("item"), F.lit(float(trust[lib])).alias("trust"), F.lit(weight).alias("structural"))) for (lib, item), (weight, rule) in DERIVES.items() if lib in trust]
    if not hits:
        return impls.sparkSession.createDataFrame([], "symbol_id string, library string, item string, source string, trust double, structural double, differences array<string>")
    met = impls.select(F.col("type_name").alias("symbol_id"), F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h"))
    return met.select("symbol_id", "h.library", "h.item", F.lit("curated").alias("source"), "h.trust", "h.structural", F.array().cast(T.ArrayType(T.StringType())).alias("differences"))


def body_matches(local: DataFrame, trust: Mapping[str, float]) -> DataFrame:
    """Loops that collect fallible results by hand, which itertools' process_results replaces."""
    hit = local.filter((F.col("cfg.loop_count") > 0) & (F.col("cfg.try_count") > 0) & F.arrays_overlap("call_sequence", F.array(*[F.lit(c) for c in ACCUMULATORS])))
    if "itertools" not in trust:
        hit = hit.limit(0)
    return hit.select("symbol_id", F.lit("itertools").alias("library"), F.lit("process_results").alias("item"), F.lit("curated").alias("source"), F.lit(float(trust.get("itertools", 0.0))).alias("trust"), F.lit(0.7).alias("structural"), F.array().cast(T.ArrayType(T.StringType())).alias("differences"))


def library_findings(local: DataFrame, impls: DataFrame, virtual: DataFrame, trust: Mapping[str, float], min_match: float = MIN_MATCH) -> DataFrame:
    """Findings 'lib-N' by confidence, symbol and item."""
    rows = signature_matches(local, virtual, min_match).unionByName(derive_matches(impls, trust)).unionByName(body_matches(local, trust))
    rows = rows.withColumn("confidence", confidence(F.col("trust"), F.col("structural"), F.col("source")))
    order = W.orderBy(F.desc("confidence"), "symbol_id", "item", "library")  # one row per finding
    return rows.select(F.concat(F.lit("lib-"), F.row_number().over(order).cast("string")).alias("id"), "symbol_id", "library", "item", "source", round_half_away(F.col("structural"), 3).alias("structural"), "differences", "confidence")
