"""The check analysis: seed roots, close effects, fold the rules, report."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.fixpoint import effect_closure
from factloom.operators.policy import Policy, run_rules
from factloom.operators.roots import rule_table, seed_roots, seed_unknowns
from factloom.storage import shared_table


@dataclass
class CheckOutcome:
    findings: DataFrame
    summaries: DataFrame
    errors: int
    report: str

    @property
    def exit_code(self) -> int:
        return 1 if self.errors else 0


def check(definitions: DataFrame, edges: DataFrame, roots: DataFrame, policy: Policy, rules: Mapping[str, str] | None = None, pure: tuple[str, ...] = (), title: str = "effect analysis") -> CheckOutcome:
    table = rule_table(definitions.sparkSession, rules or {})
    seeded = seed_roots(edges, roots, table) if policy.on_unknown == "ignore" else seed_unknowns(edges, definitions, roots, table, pure)
    seeded = shared_table(seeded, "roots")
    summaries = shared_table(effect_closure(edges, seeded), "summaries")
    findings = shared_table(run_rules(definitions, edges, seeded, summaries, policy), "findings")
    return CheckOutcome(findings, summaries, findings.filter("severity = 'error'").count(), report_text(title, definitions, summaries, findings))


def report_text(title: str, definitions: DataFrame, summaries: DataFrame, findings: DataFrame) -> str:
    """The report a person reads; its size is that of the definitions, so it is for fact bases of one project."""
    effects = summaries.groupBy(F.col("symbol").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("effect")), ", ").alias("effects"))
    lines = [title, "", "effect summaries:"]
    for r in definitions.join(effects, "id", "left").orderBy("id").select("display", "effects").toLocalIterator():
        lines.append(f"  {r['display']}: {r['effects'] or 'pure'}")
    rows = findings.orderBy("rule", "symbol", "region", "effect").select("severity", "message").collect()
    lines += ["", f"findings: {len(rows)}"] + [f"  [{r['severity']}] {r['message']}" for r in rows]
    return "\n".join(lines) + "\n"
