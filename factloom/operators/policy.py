"""Architecture policy: regions of files, the effects they forbid, and rules over the effect summaries."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions.symbols import glob_to_regex
from factloom.operators.fixpoint import effect_closure
from factloom.schemas import REAL_EFFECTS, UNKNOWN


@dataclass
class Policy:
    """regions: name -> {"paths": globs, "forbid": effects} or {"paths": globs, "allow": effects}."""

    regions: Mapping[str, Mapping[str, list[str]]] = field(default_factory=dict)
    ignore: tuple[str, ...] = ()
    on_unknown: str = "fail"
    enabled: tuple[str, ...] = ()
    rule_config: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)

    def forbidden(self, name: str) -> list[str]:
        region = self.regions[name]
        if "forbid" in region and "allow" in region:
            raise ValueError(f"region '{name}' has both allow and forbid")
        named = region.get("forbid", region.get("allow", []))
        for e in named:
            if e not in REAL_EFFECTS:
                raise ValueError(f"region '{name}': '{e}' is no effect that a region can name")
        if "allow" in region:
            return [e for e in REAL_EFFECTS if e not in named]
        return sorted(set(named), key=REAL_EFFECTS.index)

    def region_table(self, spark: SparkSession) -> DataFrame:
        """(region, regex, specificity, forbid), one row per glob."""
        rows = [(name, glob_to_regex(g), len(g.encode()), self.forbidden(name)) for name, r in self.regions.items() for g in r["paths"]]
        return spark.createDataFrame(rows, "region string, regex string, specificity int, forbid array<string>")


def not_ignored(definitions: DataFrame, policy: Policy) -> DataFrame:
    for g in policy.ignore:
        definitions = definitions.filter(~F.coalesce(F.col("file").rlike(glob_to_regex(g)), F.lit(False)))
    return definitions


def governing_regions(files: DataFrame, regions: DataFrame) -> DataFrame:
    """(file, region, forbid): the regions of the most specific glob that matches a file; equally specific ones all count.

    Globs are matched once per distinct file; the region table is configuration and is broadcast.
    """
    met = files.select("file").distinct().join(F.broadcast(regions), F.expr("file RLIKE regex"))
    best = met.groupBy("file", "region").agg(F.max("specificity").alias("specificity"), F.first("forbid").alias("forbid"))
    return best.withColumn("r", F.rank().over(W.partitionBy("file").orderBy(F.desc("specificity")))).filter("r = 1").select("file", "region", "forbid")


VIOLATION = ["rule", "symbol", "display", "file", "line_start", "line_end", "region", "effect", "evidence", "callee", "flavor", "severity", "message"]


def policy_violations(definitions: DataFrame, edges: DataFrame, summaries: DataFrame, policy: Policy) -> DataFrame:
    """Forbidden effects (errors) and, unless ignored, unknown callees reached from regions that forbid anything."""
    spark = definitions.sparkSession
    defs = not_ignored(definitions, policy)
    ruled = defs.join(governing_regions(defs, policy.region_table(spark)), "file")
    reached = ruled.join(summaries.select(F.col("symbol").alias("id"), "effect", F.col("path").alias("evidence")), "id")
    unresolved = edges.filter("resolution = 'unresolved'").select("callee", F.lit(True).alias("target")).distinct()
    trail = F.array_join("evidence", " -> ")
    head = [F.lit("effects").alias("rule"), F.col("id").alias("symbol"), "display", "file", "line_start", "line_end", "region", "effect", "evidence"]
    hit = reached.filter((F.col("effect") != UNKNOWN) & F.array_contains("forbid", F.col("effect")))
    forbidden = hit.select(
        *head, F.lit(None).cast("string").alias("callee"), F.lit(None).cast("string").alias("flavor"), F.lit("error").alias("severity"),
        F.concat("display", F.lit(" forbids "), "effect", F.lit(" in region '"), "region", F.lit("': "), trail).alias("message"),
    )
    if policy.on_unknown == "ignore":
        return forbidden
    unsure = reached.filter((F.col("effect") == UNKNOWN) & (F.size("forbid") > 0)).withColumn("callee", F.element_at("evidence", -1))
    unsure = unsure.join(unresolved, "callee", "left").withColumn("flavor", F.when(F.col("target"), "target").otherwise("effect"))
    what = F.when(F.col("target"), F.lit("an unresolved call target")).otherwise(F.concat(F.lit("unknown external `"), "callee", F.lit("`")))
    message = F.concat("display", F.lit(" cannot certify in region '"), "region", F.lit("': reaches "), what, F.lit(" — "), trail)
    unsure = unsure.select(*head, "callee", "flavor", F.lit("warning" if policy.on_unknown == "warn" else "error").alias("severity"), message.alias("message"))
    return forbidden.unionByName(unsure)


RENDER_FORBIDDEN = ("fs", "net", "db", "process")


def effect_in_component(definitions: DataFrame, edges: DataFrame, roots: DataFrame, policy: Policy) -> DataFrame:
    """Components whose render path - effect-carrying edges without seams - reaches a forbidden root."""
    config = policy.rule_config.get("effect-in-component", {})
    forbid = [e for e in config.get("forbid", []) if e in REAL_EFFECTS] or list(RENDER_FORBIDDEN)
    # one effect per root symbol, the first in the vocabulary's order
    order = F.array_position(F.array(*[F.lit(e) for e in REAL_EFFECTS]), F.col("effect"))
    bad = roots.filter(F.col("effect").isin(forbid)).groupBy("symbol").agg(F.min_by("effect", order).alias("carries"))
    near = effect_closure(edges.filter("NOT coalesce(seam, false)"), bad.select("symbol", F.lit("any").alias("effect")))
    parts = not_ignored(definitions.filter("is_component"), policy)
    hit = parts.join(near.select(F.col("symbol").alias("id"), F.col("path").alias("evidence")), "id")
    hit = hit.withColumn("root", F.element_at("evidence", -1)).join(bad.select(F.col("symbol").alias("root"), F.col("carries").alias("effect")), "root")
    message = F.concat("display", F.lit(" performs "), "effect", F.lit(" on its render path: "), F.array_join("evidence", " -> "))
    return hit.select(
        F.lit("effect-in-component").alias("rule"), F.col("id").alias("symbol"), "display", "file", "line_start", "line_end", F.lit(None).cast("string").alias("region"), "effect", "evidence",
        F.lit(None).cast("string").alias("callee"), F.lit(None).cast("string").alias("flavor"), F.lit("error").alias("severity"), message.alias("message"),
    )


#: Named rules beyond the effect regions: id -> rule(definitions, edges, roots, policy). Add to it to extend the engine.
RULES: dict[str, Callable[[DataFrame, DataFrame, DataFrame, Policy], DataFrame]] = {"effect-in-component": effect_in_component}


def run_rules(definitions: DataFrame, edges: DataFrame, roots: DataFrame, summaries: DataFrame, policy: Policy) -> DataFrame:
    """Findings of the effect regions, which always run, and of the rules that the policy enables."""
    found = policy_violations(definitions, edges, summaries, policy)
    for name in policy.enabled:
        if name in RULES:
            found = found.unionByName(RULES[name](definitions, edges, roots, policy))
    return found
