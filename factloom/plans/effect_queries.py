"""Queries on effects, roots and policy over the derived facts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.fixpoint import effect_closure, reach
from factloom.operators.policy import Policy, effect_in_component, policy_violations
from factloom.operators.roots import rule_table, seed_roots, seed_unknowns
from factloom.storage import shared_table
from factloom.views import ctes, frame

RULES = {"ext": "alloc", "op0::run": "fs", "ext::op1": "net", "ext::op2::run": "db", "run": "process", "lib2::util": "clock", "util::f": "env", "op4": "random"}
PURE = ("lib1::",)
POLICY = Policy(
    regions={
        "crm": {"paths": ["crates/crm/**"], "forbid": ["fs", "net", "process"]},
        "crm-autos": {"paths": ["crates/crm/src/auto*"], "allow": ["fs", "net", "clock", "env"]},
        "brand-row": {"paths": ["crates/cat/src/brand1?.rs"], "forbid": ["db", "fs"]},
        "brand-column": {"paths": ["crates/cat/src/brand?1.rs"], "forbid": ["fs", "random"]},
        "adapters": {"paths": ["crates/sup/**", "crates/sup/src/adapters/**"], "allow": ["fs", "net", "db", "clock", "random", "process", "env", "alloc"]},
    },
    ignore=("crates/crm/src/machinery.rs",),
    on_unknown="warn",
    enabled=("effect-in-component",),
)


ROOTS_WITH_UNKNOWN = "SELECT symbol, effect FROM {v_roots} UNION SELECT callee, 'unknown' FROM {v_edges} WHERE kind <> 'type' AND (callee LIKE 'lib%' OR resolution = 'unresolved')"


def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effect_closure(frame(spark, sf_dir, "v_edges"), frame(spark, sf_dir, "v_roots"), paths=False)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = effect_closure(frame(spark, sf_dir, "v_edges"), frame(spark, sf_dir, "v_roots"))
    return found.select("symbol", "effect", F.array_join("path", " -> ").alias("path"), (F.size("path") - 1).alias("hops"))


def effect_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = effect_closure(frame(spark, sf_dir, "v_edges"), frame(spark, sf_dir, "v_roots"), paths=False)
    return found.groupBy("symbol").agg(F.array_join(F.array_sort(F.collect_set("effect")), ",").alias("effects"), F.count("*").alias("n"))


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = frame(spark, sf_dir, "v_roots").filter("effect = 'db'")
    return seed_roots(frame(spark, sf_dir, "v_edges"), none, rule_table(spark, RULES))


def unknowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = {k: v for k, v in RULES.items() if k in ("ext::op1", "lib2::util", "op4")}
    defs, edges = frame(spark, sf_dir, "v_defs"), frame(spark, sf_dir, "v_edges")
    return seed_unknowns(edges, defs, frame(spark, sf_dir, "v_roots").filter("effect = 'db'"), rule_table(spark, few), PURE)


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    defs, edges = frame(spark, sf_dir, "v_defs"), shared_table(frame(spark, sf_dir, "v_edges").select("caller", "callee", "kind", "resolution"), "edges")
    summaries = effect_closure(edges, frame(spark, sf_dir, ROOTS_WITH_UNKNOWN, v_edges=edges))
    found = policy_violations(defs, edges, summaries, POLICY)
    return found.select("symbol", "file", "region", "effect", F.array_join("evidence", " -> ").alias("evidence"), "callee", "flavor", "severity", "message")


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = effect_in_component(frame(spark, sf_dir, "v_defs"), frame(spark, sf_dir, "v_edges"), frame(spark, sf_dir, "v_roots"), POLICY)
    return found.select("symbol", "file", "effect", F.array_join("evidence", " -> ").alias("evidence"), "message")


START = "SELECT id FROM {v_defs} WHERE file = 'crates/crm/src/building.rs'"


def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reach(frame(spark, sf_dir, "v_edges"), frame(spark, sf_dir, START))


CLOSURE_SQL = """
WITH uses AS (SELECT DISTINCT caller, callee FROM {v_edges} WHERE kind <> 'type'),
  closure(symbol, effect) AS (SELECT symbol, effect FROM {v_roots} UNION SELECT u.caller, c.effect FROM uses u JOIN closure c ON u.callee = c.symbol)
SELECT symbol, effect FROM closure"""


def trails(roots: str, cut: str = "") -> str:
    """CTEs uses, best, trail over the given roots: evidence paths by hops, then smallest next hop."""
    return f"""
WITH roots0 AS ({roots}), uses AS (SELECT DISTINCT caller, callee FROM {{v_edges}} WHERE kind <> 'type' {cut}),
  hop(symbol, effect, h) AS (SELECT symbol, effect, 0 FROM roots0 UNION SELECT u.caller, r.effect, h + 1 FROM uses u JOIN hop r ON u.callee = r.symbol WHERE h < 30),
  best AS (SELECT symbol, effect, min(h) AS h FROM hop GROUP BY 1, 2),
  nxt AS (SELECT b.symbol, b.effect, b.h, min(u.callee) AS nxt FROM best b JOIN uses u ON u.caller = b.symbol JOIN best c ON c.symbol = u.callee AND c.effect = b.effect AND c.h = b.h - 1 GROUP BY 1, 2, 3),
  trail(symbol, effect, path, last, h) AS (SELECT symbol, effect, symbol, symbol, 0 FROM best WHERE h = 0
    UNION ALL SELECT n.symbol, n.effect, n.symbol || ' -> ' || t.path, t.last, n.h FROM nxt n JOIN trail t ON t.symbol = n.nxt AND t.effect = n.effect AND t.h = n.h - 1)"""


_RULES_SQL = lambda rules: ", ".join(f"('{n}', '{e}', {len([p for p in n.split('::') if p])}, {i})" for i, (n, e) in enumerate(rules.items()))

SEEDED_SQL = f"""
WITH rules(needle, effect, segments, place) AS (VALUES {_RULES_SQL(RULES)}),
  callees AS (SELECT DISTINCT callee FROM {{v_edges}} WHERE kind <> 'type'),
  met AS (SELECT callee, r.effect, row_number() OVER (PARTITION BY callee ORDER BY segments DESC, place DESC) AS n FROM callees JOIN rules r ON contains('::' || callee || '::', '::' || needle || '::'))
SELECT symbol, effect FROM {{v_roots}} WHERE effect = 'db' UNION SELECT callee, effect FROM met WHERE n = 1"""

UNKNOWN_SQL = f"""
WITH rules(needle, effect, segments, place) AS (VALUES {_RULES_SQL({k: RULES[k] for k in ("ext::op1", "lib2::util", "op4")})}),
  callees AS (SELECT callee, bool_or(resolution = 'unresolved') AS indirect FROM {{v_edges}} WHERE kind <> 'type' GROUP BY callee),
  met AS (SELECT callee, r.effect, row_number() OVER (PARTITION BY callee ORDER BY segments DESC, place DESC) AS n FROM callees JOIN rules r ON contains('::' || callee || '::', '::' || needle || '::')),
  base AS (SELECT symbol, effect FROM {{v_roots}} WHERE effect = 'db' UNION SELECT callee, effect FROM met WHERE n = 1)
SELECT symbol, effect FROM base UNION SELECT callee, 'unknown' FROM callees WHERE indirect OR NOT (split_part(callee, '::', 1) IN (SELECT DISTINCT split_part(id, '::', 1) FROM {{v_defs}})
  OR callee IN (SELECT symbol FROM base) OR contains(callee, 'lib1::'))"""

VIOLATIONS_SQL = trails(ROOTS_WITH_UNKNOWN) + """,
  regions(region, pattern, specificity, forbid) AS (VALUES ('crm', '^crates/crm/.*$', 13, ['fs', 'net', 'process']),
    ('crm-autos', '^crates/crm/src/auto.*$', 20, ['db', 'random', 'process', 'alloc']), ('brand-row', '^crates/cat/src/brand1.[.]rs$', 25, ['db', 'fs']),
    ('brand-column', '^crates/cat/src/brand.1[.]rs$', 25, ['fs', 'random']), ('adapters', '^crates/sup/.*$', 13, []), ('adapters', '^crates/sup/src/adapters/.*$', 26, [])),
  met AS (SELECT d.id, d.display, d.file, r.region, r.forbid, rank() OVER (PARTITION BY d.id ORDER BY specificity DESC) AS k FROM {v_defs} d JOIN regions r ON regexp_matches(d.file, r.pattern)
    WHERE d.file <> 'crates/crm/src/machinery.rs'),
  reached AS (SELECT m.*, t.effect, t.path, t.last FROM met m JOIN trail t ON t.symbol = m.id WHERE k = 1)
SELECT id AS symbol, file, region, effect, path AS evidence, NULL AS callee, NULL AS flavor, 'error' AS severity, display || ' forbids ' || effect || ' in region ''' || region || ''': ' || path AS message
  FROM reached WHERE effect <> 'unknown' AND list_contains(forbid, effect)
UNION ALL SELECT id, file, region, effect, path, last, CASE WHEN t THEN 'target' ELSE 'effect' END, 'warning',
    display || ' cannot certify in region ''' || region || ''': reaches ' || CASE WHEN t THEN 'an unresolved call target' ELSE 'unknown external `' || last || '`' END || ' — ' || path
  FROM (SELECT *, last IN (SELECT callee FROM {v_edges} WHERE resolution = 'unresolved') AS t FROM reached WHERE effect = 'unknown' AND len(forbid) > 0)"""

COMPONENTS_SQL = trails("SELECT symbol, 'any' AS effect FROM {v_roots} WHERE effect IN ('fs', 'net', 'db', 'process')", "AND NOT seam") + """
SELECT d.id AS symbol, d.file, r.effect, t.path AS evidence, d.display || ' performs ' || r.effect || ' on its render path: ' || t.path AS message
FROM {v_defs} d JOIN trail t ON t.symbol = d.id JOIN {v_roots} r ON r.symbol = t.last WHERE d.is_component AND d.file <> 'crates/crm/src/machinery.rs'"""

REACH_SQL = f"""
WITH uses AS (SELECT DISTINCT caller, callee FROM {{v_edges}}),
  walk(id, h) AS ({START.replace("SELECT id", "SELECT id, 0")} UNION SELECT u.callee, h + 1 FROM uses u JOIN walk w ON u.caller = w.id WHERE h < 30)
SELECT id, CAST(min(h) AS INTEGER) AS hops FROM walk GROUP BY id"""

QUERIES = {
    "effect_closure": effects, "effect_evidence": evidence, "effect_sets": effect_sets, "roots_seeded": seeded, "roots_unknown": unknowns,
    "policy_violations": violations, "effect_in_component": components, "dependency_closure": closure,
}
SQL = {
    "effect_closure": ctes(CLOSURE_SQL, True),
    "effect_evidence": ctes(trails("SELECT symbol, effect FROM {v_roots}") + " SELECT symbol, effect, path, CAST(h AS INTEGER) AS hops FROM trail", True),
    "effect_sets": ctes(CLOSURE_SQL.replace("SELECT symbol, effect FROM closure", "SELECT symbol, string_agg(effect, ',' ORDER BY effect) AS effects, count(*) AS n FROM closure GROUP BY symbol"), True),
    "roots_seeded": ctes(SEEDED_SQL), "roots_unknown": ctes(UNKNOWN_SQL), "policy_violations": ctes(VIOLATIONS_SQL, True),
    "effect_in_component": ctes(COMPONENTS_SQL, True), "dependency_closure": ctes(REACH_SQL, True),
}
