"""Seeding effect roots from prefix rules, and what stays unknown."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.symbols import leading_crate, segment_runs, strip_generics, trusted_pure
from factloom.operators.fixpoint import carries_effects
from factloom.schemas import UNKNOWN


def rule_table(spark: SparkSession, rules: Mapping[str, str]) -> DataFrame:
    """(needle, effect, segments, place) of prefix rules in their order; needles are whole path segments."""
    rows = []
    for place, (prefix, effect) in enumerate(rules.items()):
        parts = [p for p in prefix.split("::") if p]
        if parts:
            rows.append(("::".join(parts), effect, len(parts), place))
    return spark.createDataFrame(rows, "needle string, effect string, segments int, place int")


def effects_of(callees: DataFrame, rules: DataFrame) -> DataFrame:
    """(callee, effect) by the rule whose segments are a run of the callee's; most segments win, then the last rule.

    Every run of a callee's segments is a key of an equi-join, so no callee is compared with all rules.
    """
    runs = callees.select("callee", F.explode(segment_runs(strip_generics(F.col("callee")))).alias("needle"))
    met = runs.join(F.broadcast(rules), "needle")  # rules are configuration
    return met.groupBy("callee").agg(F.max_by("effect", F.struct("segments", "place")).alias("effect"))


def seed_roots(edges: DataFrame, roots: DataFrame, rules: DataFrame) -> DataFrame:
    """roots plus the rules' roots for callees of effect-carrying edges; a root is never there twice."""
    callees = carries_effects(edges).select("callee").distinct()
    found = effects_of(callees, rules).select(F.col("callee").alias("symbol"), "effect")
    return roots.select("symbol", "effect").unionByName(found.join(roots, ["symbol", "effect"], "left_anti"))


def seed_unknowns(edges: DataFrame, definitions: DataFrame, roots: DataFrame, rules: DataFrame, pure: tuple[str, ...] = ()) -> DataFrame:
    """seed_roots() plus an 'unknown' root for each callee that nothing accounts for.

    A callee is unknown if an edge to it is unresolved, or if it is no definition (by id, by path without generics, or by
    its crate), has no real root, and is neither declared pure, nor covered by a rule, nor by the trusted baseline.
    """
    seeded = seed_roots(edges, roots, rules)
    uses = carries_effects(edges)
    callees = uses.groupBy("callee").agg(F.bool_or(F.col("resolution") == "unresolved").alias("indirect"))
    stripped = strip_generics(F.col("callee"))
    ids = definitions.select(F.col("id").alias("callee"), F.lit(True).alias("by_id")).distinct()
    paths = definitions.select(strip_generics(F.col("id")).alias("stripped"), F.lit(True).alias("by_path")).distinct()
    crates = definitions.select(leading_crate(F.col("id")).alias("crate"), F.lit(True).alias("by_crate")).filter("crate IS NOT NULL").distinct()
    real = seeded.filter(F.col("effect") != UNKNOWN).select(F.col("symbol").alias("callee"), F.lit(True).alias("rooted")).distinct()
    known = callees.withColumn("stripped", stripped).withColumn("crate", leading_crate(F.col("callee")))
    for side, on in ((ids, "callee"), (paths, "stripped"), (crates, "crate"), (real, "callee")):
        known = known.join(side, on, "left")
    accounted = F.lit(False)
    for c in ("by_id", "by_path", "by_crate", "rooted"):
        accounted |= F.coalesce(F.col(c), F.lit(False))
    for p in pure:
        accounted |= F.col("callee").contains(p)
    matched = effects_of(callees, rules).select("callee", F.lit(True).alias("ruled"))
    known = known.join(matched, "callee", "left")
    accounted |= F.coalesce(F.col("ruled"), F.lit(False)) | trusted_pure(F.col("callee"))
    unknown = known.filter(F.col("indirect") | ~accounted).select(F.col("callee").alias("symbol"), F.lit(UNKNOWN).alias("effect"))
    return seeded.unionByName(unknown.join(seeded, ["symbol", "effect"], "left_anti"))
