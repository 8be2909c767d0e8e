"""Queries on the dependency graph and the work plan over the derived facts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import graph as G
from factloom.operators import plan as P
from factloom.operators.fixpoint import effect_closure
from factloom.storage import shared_table
from factloom.views import ctes, frame

join = lambda c: F.array_join(c, ",").alias(c)


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.graph_nodes(frame(spark, sf_dir, "v_defs"), frame(spark, sf_dir, "v_edges"))


def _inner(spark: SparkSession, sf_dir: str, **given: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = frame(spark, sf_dir, "v_defs").select("id")
    return nodes, frame(spark, sf_dir, "SELECT caller, callee FROM {v_edges} WHERE caller IN (SELECT id FROM {v_defs}) AND callee IN (SELECT id FROM {v_defs}) AND caller <> callee", **given)


def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = G.degrees(_nodes(spark, sf_dir), frame(spark, sf_dir, "v_edges"))
    return d.select("id", "fan_in", "fan_out", "is_leaf", join("external_packages"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("id", "display", "file", "loc", "external")


def graph_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = frame(spark, sf_dir, "v_edges")
    roots = frame(spark, sf_dir, "SELECT DISTINCT callee AS symbol, 'unknown' AS effect FROM {v_edges} WHERE callee LIKE 'lib3%'")
    return G.edge_provenance(edges, _nodes(spark, sf_dir), roots).select("caller", "callee", "kind", "resolution", "provenance")


def graph_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    defs, edges = frame(spark, sf_dir, "v_defs"), shared_table(frame(spark, sf_dir, "v_edges").select("caller", "callee", "kind"), "edges")
    effects = effect_closure(edges, frame(spark, sf_dir, "v_roots"), paths=False)
    return G.file_rollup(G.symbol_sets(defs, edges, effects)).select("path", "symbol_count", "loc", join("effect_roots"), join("external_packages"))


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = shared_table(frame(spark, sf_dir, "v_edges").select("caller", "callee"), "edges")
    defs = frame(spark, sf_dir, "v_defs")
    nodes, inner = _inner(spark, sf_dir, v_edges=edges)
    cycles = G.condensation(nodes, inner).filter("scc IS NOT NULL").select("id", "scc")
    return G.graph_stats(G.graph_nodes(defs, edges).select("id", "external", "file").join(cycles, "id", "left"), edges)


def graph_file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.file_edges(frame(spark, sf_dir, "v_defs"), frame(spark, sf_dir, "v_edges"))


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.condensation(*_inner(spark, sf_dir))


def graph_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.transitive_counts(frame(spark, sf_dir, "v_edges"))


def graph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping graphs: one where suppliers are outside symbols, one where they are defined."""
    parts = [frame(spark, sf_dir, f"SELECT * FROM {{v_edges}} WHERE {w}") for w in ("kind <> 'reference'", "kind <> 'type'")]
    defs = [frame(spark, sf_dir, f"SELECT * FROM {{v_defs}} WHERE {w}") for w in ("id NOT LIKE 'sup%'", "id NOT LIKE 'crm%'")]
    nodes = [G.graph_nodes(d, e).withColumn("graph", F.lit(i)) for i, (d, e) in enumerate(zip(defs, parts))]
    links = [e.withColumn("graph", F.lit(i)) for i, e in enumerate(parts)]
    symbols, edges = G.merge_graphs(nodes[0].unionByName(nodes[1]), links[0].unionByName(links[1]))
    per = edges.groupBy(F.col("caller").alias("id")).agg(F.count("*").alias("edges"))
    return symbols.join(per, "id", "left").select("id", "file", "external", F.coalesce("edges", F.lit(0)).alias("edges"))


def graph_reroot(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, edges = G.reroot(_nodes(spark, sf_dir), frame(spark, sf_dir, "v_edges"), "crates/cat/")
    return edges.join(symbols.select(F.col("id").alias("caller"), F.col("file").alias("from_file")), "caller").select("caller", "callee", "kind", "from_file")


def graph_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = shared_table(_nodes(spark, sf_dir), "nodes")
    out = None
    for p in ("cat::P7", "P12", "util", "src/building", "no-such-symbol"):
        found = G.resolve_pattern(nodes, p).select(F.lit(p).alias("pattern"), "id", "tier")
        out = found if out is None else out.unionByName(found)
    return out


def enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = frame(spark, sf_dir, "SELECT DISTINCT concat('crates/cat/src/', lower(replace(p_brand, '#', '')), '.rs') AS file, CAST(p_partkey * 7 % 360 AS INT) AS line FROM {part}")
    return G.enclosing_definition(sites, frame(spark, sf_dir, "v_defs"))


PLAN_EDGES = "SELECT a AS `from`, b AS `to`, n % 2 = 1 AS has_unknown FROM {v_files} WHERE n >= 2 AND (a < b OR length(a) % 3 = 0)"


def _plan_input(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = frame(spark, sf_dir, "SELECT file AS path, sum(line_end - line_start + 1) AS loc, count(*) AS symbol_count, array('fs') AS effect_roots, array('ext') AS external_packages FROM {v_defs} GROUP BY file")
    return files, frame(spark, sf_dir, PLAN_EDGES)


def plan_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.plan_groups(*_plan_input(spark, sf_dir))
    return g.select("id", "reason", join("files"), "loc", "symbol_count", "wave", join("depends_on"), join("unlocks"), "has_unknown_edges")


def plan_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.plan_waves(P.plan_groups(*_plan_input(spark, sf_dir))).select("wave", join("group_ids"), join("files"), "loc", "group_count")


def plan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.plan_stats(P.plan_groups(*_plan_input(spark, sf_dir)))


def plan_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.plan_groups(*_plan_input(spark, sf_dir), max_group_loc=3000, coalesce=True)
    return g.select("id", "reason", join("files"), "loc", "wave", join("depends_on"))


PAIRS = "pairs AS (SELECT DISTINCT caller, callee FROM {v_edges} WHERE caller <> callee)"
ENDS = "ends AS (SELECT caller AS id FROM {v_edges} UNION SELECT callee FROM {v_edges} UNION SELECT id FROM {v_defs})"


def _components_sql(nodes: str, pairs: str) -> str:
    """CTEs comp(id, component), level(component, level) from SQL of nodes(id) and pairs(caller, callee)."""
    return f"""
WITH nodes0 AS ({nodes}), pairs0 AS ({pairs}),
  far(src, dst) AS (SELECT caller, callee FROM pairs0 UNION SELECT f.src, p.callee FROM far f JOIN pairs0 p ON f.dst = p.caller),
  comp AS (SELECT n.id, least(n.id, coalesce(min(f.dst), n.id)) AS component FROM nodes0 n LEFT JOIN (SELECT a.src, a.dst FROM far a JOIN far b ON a.src = b.dst AND a.dst = b.src) f ON f.src = n.id GROUP BY n.id),
  lifted AS (SELECT DISTINCT a.component AS x, b.component AS y FROM pairs0 p JOIN comp a ON a.id = p.caller JOIN comp b ON b.id = p.callee WHERE a.component <> b.component),
  climb(component, level) AS (SELECT DISTINCT component, 0 FROM comp UNION SELECT l.x, c.level + 1 FROM lifted l JOIN climb c ON l.y = c.component),
  level AS (SELECT component, CAST(max(level) AS INTEGER) AS level FROM climb GROUP BY component)"""


_PLAN_EDGES = PLAN_EDGES.replace("`", '"')
_PLAN = _components_sql("SELECT DISTINCT file AS id FROM {v_defs}", f'SELECT "from" AS caller, "to" AS callee FROM ({_PLAN_EDGES})') + f""",
  files AS (SELECT file AS path, sum(line_end - line_start + 1) AS loc, count(*) AS symbol_count FROM {{v_defs}} GROUP BY file),
  numbered AS (SELECT component, level AS wave, row_number() OVER (ORDER BY level, component) - 1 AS number FROM level),
  unsure AS (SELECT unnest(["from", "to"]) AS path FROM ({_PLAN_EDGES}) WHERE has_unknown),
  rolled AS (SELECT n.number, any_value(n.wave) AS wave, any_value(n.component) AS component, string_agg(f.path, ',' ORDER BY f.path) AS files, count(*) AS size, sum(loc) AS loc, sum(symbol_count) AS symbol_count,
    bool_or(f.path IN (SELECT path FROM unsure)) AS has_unknown_edges FROM numbered n JOIN comp c ON c.component = n.component JOIN files f ON f.path = c.id GROUP BY n.number),
  down AS (SELECT a.number, string_agg('group:' || b.number, ',' ORDER BY b.number) AS ids FROM lifted l JOIN numbered a ON a.component = l.x JOIN numbered b ON b.component = l.y GROUP BY a.number),
  up AS (SELECT b.number, string_agg('group:' || a.number, ',' ORDER BY a.number) AS ids FROM lifted l JOIN numbered a ON a.component = l.x JOIN numbered b ON b.component = l.y GROUP BY b.number),
  groups AS (SELECT 'group:' || r.number AS id, r.number, CASE WHEN size > 1 THEN 'cycle' ELSE 'singleton' END AS reason, files, CAST(loc AS BIGINT) AS loc, CAST(symbol_count AS BIGINT) AS symbol_count, wave,
    coalesce(d.ids, '') AS depends_on, coalesce(u.ids, '') AS unlocks, has_unknown_edges FROM rolled r LEFT JOIN down d USING (number) LEFT JOIN up u USING (number))"""

_EFFECTS = """uses AS (SELECT DISTINCT caller, callee FROM {v_edges} WHERE kind <> 'type'),
  closure(symbol, effect) AS (SELECT symbol, effect FROM {v_roots} UNION SELECT u.caller, c.effect FROM uses u JOIN closure c ON u.callee = c.symbol)"""

SQL = {
    "graph_nodes": ctes(f"WITH {ENDS} SELECT e.id, coalesce(d.display, e.id) AS display, d.file, greatest(d.line_end - d.line_start, 0) + 1 AS loc, d.id IS NULL AS external FROM ends e LEFT JOIN {{v_defs}} d ON d.id = e.id").replace(
        "greatest(d.line_end - d.line_start, 0) + 1 AS loc", "CASE WHEN d.id IS NOT NULL THEN greatest(d.line_end - d.line_start, 0) + 1 END AS loc"
    ),
    "graph_degrees": ctes(f"""WITH {PAIRS}, {ENDS},
  o AS (SELECT caller AS id, count(*) AS fan_out, count(d.id) AS inner_, coalesce(string_agg(DISTINCT CASE WHEN d.id IS NULL THEN split_part(callee, '::', 1) END, ',' ORDER BY CASE WHEN d.id IS NULL THEN split_part(callee, '::', 1) END), '') AS pk
    FROM pairs LEFT JOIN {{v_defs}} d ON d.id = callee GROUP BY caller),
  i AS (SELECT callee AS id, count(*) AS fan_in FROM pairs GROUP BY callee)
SELECT e.id, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, coalesce(inner_, 0) = 0 AS is_leaf, coalesce(pk, '') AS external_packages FROM ends e LEFT JOIN o USING (id) LEFT JOIN i USING (id)"""),
    "graph_provenance": ctes("""SELECT caller, callee, kind, resolution, CASE WHEN callee IN (SELECT id FROM {v_defs}) THEN CASE WHEN resolution = 'unresolved' THEN 'unknown' ELSE 'resolved' END
  WHEN resolution = 'unresolved' OR callee LIKE 'lib3%' THEN 'unknown' ELSE 'external' END AS provenance FROM {v_edges}"""),
    "graph_files": ctes(f"""WITH {_EFFECTS},
  f AS (SELECT file AS path, count(*) AS symbol_count, CAST(sum(greatest(line_end - line_start, 0) + 1) AS BIGINT) AS loc FROM {{v_defs}} GROUP BY file),
  e AS (SELECT d.file AS path, string_agg(DISTINCT c.effect, ',' ORDER BY c.effect) AS x FROM {{v_defs}} d JOIN closure c ON c.symbol = d.id GROUP BY d.file),
  p AS (SELECT d.file AS path, string_agg(DISTINCT split_part(callee, '::', 1), ',' ORDER BY split_part(callee, '::', 1)) AS x FROM {{v_defs}} d JOIN {{v_edges}} v ON v.caller = d.id WHERE v.callee NOT IN (SELECT id FROM {{v_defs}}) GROUP BY d.file)
SELECT f.*, coalesce(e.x, '') AS effect_roots, coalesce(p.x, '') AS external_packages FROM f LEFT JOIN e USING (path) LEFT JOIN p USING (path)""", True),
    "graph_file_edges": ctes("""SELECT d.file AS "from", e.file AS "to", count(*) AS call_edge_count, bool_or(resolution = 'unresolved') AS has_unknown FROM {v_edges} x JOIN {v_defs} d ON d.id = x.caller JOIN {v_defs} e ON e.id = x.callee WHERE d.file <> e.file GROUP BY 1, 2"""),
    "graph_components": ctes(_components_sql("SELECT id FROM {v_defs}", "SELECT DISTINCT caller, callee FROM {v_edges} WHERE caller IN (SELECT id FROM {v_defs}) AND callee IN (SELECT id FROM {v_defs}) AND caller <> callee") + """,
  sized AS (SELECT component, count(*) AS size FROM comp GROUP BY component),
  named AS (SELECT component, 'scc:' || (row_number() OVER (ORDER BY level, component) - 1) AS scc FROM sized JOIN level USING (component) WHERE size > 1)
SELECT c.id, c.component, s.size, n.scc, l.level FROM comp c JOIN sized s USING (component) JOIN level l USING (component) LEFT JOIN named n USING (component)""", True),
    "graph_stats": ctes(_components_sql("SELECT id FROM {v_defs}", "SELECT DISTINCT caller, callee FROM {v_edges} WHERE caller IN (SELECT id FROM {v_defs}) AND callee IN (SELECT id FROM {v_defs}) AND caller <> callee") + f""",
  {ENDS} SELECT (SELECT count(*) FROM {{v_defs}}) AS symbols, (SELECT count(*) FROM ends WHERE id NOT IN (SELECT id FROM {{v_defs}})) AS external_symbols, (SELECT count(DISTINCT file) FROM {{v_defs}}) AS files,
  (SELECT count(*) FROM (SELECT component FROM comp GROUP BY component HAVING count(*) > 1)) AS cycles, (SELECT count(*) FROM {{v_edges}}) AS edges""", True),
    "graph_transitive": ctes(f"""WITH {PAIRS}, far(src, dst) AS (SELECT caller, callee FROM pairs UNION SELECT f.src, p.callee FROM far f JOIN pairs p ON f.dst = p.caller)
SELECT src AS id, count(*) AS transitive_dep_count FROM far WHERE src <> dst GROUP BY src""", True),
    "graph_merge": ctes("""WITH n0 AS (SELECT id, file, false AS external, 0 AS g FROM {v_defs} WHERE id NOT LIKE 'sup%' UNION ALL SELECT DISTINCT x, NULL, true, 0 FROM (SELECT unnest([caller, callee]) AS x FROM {v_edges} WHERE kind <> 'reference') WHERE x NOT IN (SELECT id FROM {v_defs} WHERE id NOT LIKE 'sup%')
    UNION ALL SELECT id, file, false, 1 FROM {v_defs} WHERE id NOT LIKE 'crm%' UNION ALL SELECT DISTINCT x, NULL, true, 1 FROM (SELECT unnest([caller, callee]) AS x FROM {v_edges} WHERE kind <> 'type') WHERE x NOT IN (SELECT id FROM {v_defs} WHERE id NOT LIKE 'crm%')),
  n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY external, g) AS k FROM n0), e AS (SELECT caller AS id, count(*) AS edges FROM {v_edges} GROUP BY caller)
SELECT n.id, n.file, n.external, coalesce(e.edges, 0) AS edges FROM n LEFT JOIN e USING (id) WHERE k = 1"""),
    "graph_reroot": ctes("""SELECT x.caller, x.callee, x.kind, substring(d.file, 12) AS from_file FROM {v_edges} x JOIN {v_defs} d ON d.id = x.caller JOIN {v_defs} e ON e.id = x.callee WHERE d.file LIKE 'crates/cat/%' AND e.file LIKE 'crates/cat/%'"""),
    "graph_resolve": ctes(f"""WITH {ENDS}, p(pattern) AS (VALUES ('cat::P7'), ('P12'), ('util'), ('src/building'), ('no-such-symbol')),
  m AS (SELECT pattern, e.id, CASE WHEN e.id = pattern THEN 1 WHEN ends_with(e.id, pattern) OR coalesce(d.display, e.id) = pattern OR split_part(e.id, '::', -1) = pattern THEN 2 WHEN contains(e.id, pattern) THEN 3 WHEN contains(d.file, pattern) THEN 4 END AS tier
    FROM p, ends e LEFT JOIN {{v_defs}} d ON d.id = e.id)
SELECT pattern, id, tier FROM (SELECT *, min(tier) OVER (PARTITION BY pattern) AS best FROM m WHERE tier IS NOT NULL) WHERE tier = best"""),
    "enclosing_definition": ctes("""WITH s AS (SELECT DISTINCT concat('crates/cat/src/', lower(replace(p_brand, '#', '')), '.rs') AS file, CAST(p_partkey * 7 % 360 AS INT) AS line FROM {part}),
  m AS (SELECT s.file, s.line, d.id, row_number() OVER (PARTITION BY s.file, s.line ORDER BY d.line_end - d.line_start, d.id) AS k FROM s LEFT JOIN {v_defs} d ON d.file = s.file AND s.line BETWEEN d.line_start AND d.line_end)
SELECT file, line, coalesce(id, '<module>@' || file) AS owner FROM m WHERE k = 1"""),
    "plan_groups": ctes(_PLAN + " SELECT id, reason, files, loc, symbol_count, wave, depends_on, unlocks, has_unknown_edges FROM groups", True),
    "plan_waves": ctes(_PLAN + """, paths AS (SELECT g.wave, string_agg(c.id, ',' ORDER BY c.id) AS files FROM numbered g JOIN comp c USING (component) GROUP BY g.wave)
SELECT g.wave, string_agg(id, ',' ORDER BY number) AS group_ids, any_value(p.files) AS files, CAST(sum(loc) AS BIGINT) AS loc, count(*) AS group_count FROM groups g JOIN paths p USING (wave) GROUP BY g.wave""", True),
    "plan_stats": ctes(_PLAN + """ SELECT count(*) AS groups, CAST(max(wave) + 1 AS INTEGER) AS waves, max(loc) AS largest_group_loc, count(*) FILTER (WHERE reason = 'cycle') AS cycle_groups, 0 AS coalesced_groups,
  count(*) FILTER (WHERE reason = 'singleton') AS singleton_groups, CAST(sum(loc) AS BIGINT) AS total_loc FROM groups""", True),
}
QUERIES = {
    "graph_nodes": graph_nodes, "graph_degrees": graph_degrees, "graph_provenance": graph_provenance, "graph_files": graph_files, "graph_file_edges": graph_file_edges, "graph_components": graph_components,
    "graph_stats": graph_stats, "graph_transitive": graph_transitive, "graph_merge": graph_merge, "graph_reroot": graph_reroot, "graph_resolve": graph_resolve, "enclosing_definition": enclosing,
    "plan_groups": plan_groups, "plan_waves": plan_waves, "plan_stats": plan_stats, "plan_coalesced": plan_coalesced,
}
