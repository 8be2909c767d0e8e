"""Queries on port progress over two graphs derived from the part table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.naming import NamingRules, camel_to_snake, is_pascal, is_screaming, kebab_to_snake, norm_leaf, source_module, target_module
from factloom.operators import portdiff as D
from factloom.storage import shared_table
from factloom.views import ctes, frame

RULES = NamingRules(target_src_prefix=("crates/port/src", "crates/aux/src"))

SOURCE = """SELECT id, min(file) AS file, false AS external, min(k) AS k FROM (SELECT id, concat('src/', b, '/size-', s, '.ts') AS file, false AS external, k FROM (SELECT *, concat('src/', b, '/size-', s, '#', CASE k % 6 WHEN 0 THEN concat('loadItem', k % 60) WHEN 1 THEN concat('BrandModel', k % 40)
    WHEN 2 THEN concat('MAX_SIZE_', k % 50) WHEN 3 THEN concat('Store.fetchAll', k % 30) WHEN 4 THEN concat('parseHTMLDoc', k % 70) ELSE concat('cb@', k) END) AS id
  FROM (SELECT p_partkey AS k, lower(replace(p_brand, '#', '-')) AS b, p_size % 6 AS s FROM {part}) p) q) u GROUP BY id"""
TARGET = """SELECT id, min(file) AS file, false AS external, min(k) AS k FROM (SELECT CASE WHEN k % 11 = 0 THEN concat('<', b, ' as Port>::', leaf) ELSE concat(m, '::', b, '::', leaf) END AS id, concat('crates/', m, '/src/', b, '/size_', s, '.rs') AS file, false AS external, k FROM (
  SELECT *, CASE k % 6 WHEN 0 THEN concat('load_item', k % 60) WHEN 1 THEN concat('BrandModel', k % 40) WHEN 2 THEN concat('MAX_SIZE_', k % 50) WHEN 3 THEN concat('fetch_all', k % 30) WHEN 4 THEN concat('parse_html_doc', k % 70) ELSE concat(chr(123), 'closure#', k, chr(125)) END AS leaf,
    CASE WHEN k % 13 < 9 THEN 'port' ELSE 'aux' END AS m FROM (SELECT p_partkey AS k, lower(replace(replace(p_brand, '#', '_'), '4', '3')) AS b, (p_size + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END) % 5 AS s FROM {part} WHERE p_partkey % 3 <> 0) p) q) u GROUP BY id"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(source files, source symbols, target symbols)."""
    raw = frame(spark, sf_dir, SOURCE)
    return raw.select("file").distinct(), D.source_symbols(raw, RULES), D.target_symbols(frame(spark, sf_dir, TARGET), RULES)


def naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = frame(spark, sf_dir, "SELECT DISTINCT concat(CASE p_size % 4 WHEN 0 THEN 'get' WHEN 1 THEN 'HTTPServer' WHEN 2 THEN 'MAX_' ELSE 'kebab-case' END, replace(replace(p_brand, '#', ''), 'Brand', CASE p_size % 3 WHEN 0 THEN 'ID' ELSE 'Name' END), p_size % 7) AS name, concat('src/', lower(p_type), '/My-', p_size, CASE p_size % 3 WHEN 0 THEN '.lazy.tsx' ELSE '.ts' END) AS file, concat('crates/', lower(p_type), '/src/a/b', p_size, CASE p_size % 2 WHEN 0 THEN '/mod.rs' ELSE '.rs' END) AS target FROM {part}")
    n = F.col("name")
    return names.select("name", camel_to_snake(n).alias("snake"), is_screaming(n).alias("screaming"), is_pascal(n).alias("pascal"), norm_leaf(n).alias("leaf"), kebab_to_snake(n).alias("kebab"), source_module(F.col("file")).alias("source_module"), target_module(F.col("target")).alias("target_module"))


def _matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    files, src, tgt = _sides(spark, sf_dir)
    tgt = shared_table(tgt, "targets")
    mapped = shared_table(D.map_files(files, src, tgt, rules=RULES), "file-map")
    return files, tgt, mapped, shared_table(D.match_symbols(src, tgt, mapped), "matched")


def file_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir)[2]


def symbol_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir)[3]




def confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, tgt, _, matched = _matched(spark, sf_dir)
    return D.confirm_by_graph(matched, _calls(spark, sf_dir, SOURCE), _calls(spark, sf_dir, TARGET), tgt)


def _calls(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    rows = frame(spark, sf_dir, side).select("id", "k")
    a, b = rows.select(F.col("id").alias("caller"), F.explode(F.array(F.col("k").bitwiseXOR(F.lit(12)), F.col("k") + 6)).alias("k")), rows.select(F.col("id").alias("callee"), "k")
    return a.join(b, "k").select("caller", "callee").distinct()


def _bands(spark: SparkSession, sf_dir: str, threshold: float = 0.6) -> DataFrame:
    files, tgt, mapped, matched = _matched(spark, sf_dir)
    native = files.filter("file LIKE '%brand-11/size-1%'").select("file")
    return shared_table(D.file_bands(files, matched, tgt, mapped, native=native, threshold=threshold), "bands")


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bands(spark, sf_dir)


FILE_LINKS = "SELECT DISTINCT a.file AS `from`, b.file AS `to` FROM ({source}) a JOIN ({source}) b ON b.k = a.k + 9 AND a.k % 8 = 0".replace("{source}", SOURCE)


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = frame(spark, sf_dir, FILE_LINKS)
    fan_in = links.filter("`from` <> `to`").groupBy(F.col("to").alias("path")).agg(F.count("*").alias("fan_in"))
    return D.ready_frontier(_bands(spark, sf_dir), links, fan_in, top=None, rules=RULES).select("path", "band", "fan_in", "dep_count")


def _contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, tgt, _, matched = _matched(spark, sf_dir)
    rows = D.contributions(matched, tgt)
    return shared_table(rows.withColumn("package", F.regexp_extract("file", "^src/([^/]*)", 1)), "contributions")


def merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = D.file_merges(_contributions(spark, sf_dir))
    return m.select("target_file", "contributors", "strong", F.array_join("packages", ",").alias("packages"), F.array_join("source_files", ",").alias("source_files"), "cross_package")


def misplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.misplacements(_contributions(spark, sf_dir))


SNAPSHOT = """SELECT concat('p', k % 4) AS package, concat('f', k) AS path, CASE k * {m} % 5 WHEN 0 THEN 'NOT-STARTED' WHEN 1 THEN 'STARTED' WHEN 2 THEN 'RELOCATED' WHEN 3 THEN 'PORTED' ELSE 'DONE' END AS band,
  CASE WHEN k % 6 <> {z} THEN CAST(k * {m} % 101 AS DOUBLE) / 101 END AS coverage, CAST(k % 30 AS BIGINT) AS total_symbols, CAST(k * {m} % (k % 30 + 1) AS BIGINT) AS matched_symbols FROM (SELECT p_partkey AS k FROM {part}) p WHERE k % 9 <> {z}"""
BEFORE, AFTER = (SNAPSHOT.replace("{m}", m).replace("{z}", z) for m, z in (("3", "2"), ("7", "5")))


def _delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.report_delta(frame(spark, sf_dir, BEFORE), frame(spark, sf_dir, AFTER))


def delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delta(spark, sf_dir)


def delta_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.delta_totals(_delta(spark, sf_dir))


def delta_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.delta_transitions(_delta(spark, sf_dir))


def package_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.package_totals(frame(spark, sf_dir, AFTER))


_SNAKE = "lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'))"
_KEEP = "(regexp_full_match({0}, '[A-Z0-9]+(_[A-Z0-9]+)*') AND regexp_matches({0}, '[A-Z]') OR regexp_matches({0}, '^[A-Z]') AND regexp_matches({0}, '[a-z]'))"
_LEAF = f"CASE WHEN {_KEEP} THEN {{0}} ELSE {_SNAKE} END"
_CTES = f"""
WITH s0 AS ({SOURCE}), t0 AS ({TARGET}),
  src AS (SELECT id, file, replace(substring(file, 5, length(file) - 7), '-', '_') AS module, {_LEAF.format("split_part(split_part(id, '#', 2), '.', -1)")} AS leaf FROM s0 WHERE NOT contains(id, '@')),
  tgt AS (SELECT id, file, regexp_replace(split_part(file, '/src/', 2), '[.]rs$', '') AS module, split_part(id, '::', -1) AS leaf, id LIKE '<%' AS is_impl, file LIKE 'crates/port/src/%' AS is_primary FROM t0 WHERE NOT contains(id, '{{closure')),
  below AS (SELECT DISTINCT module, unnest([array_to_string(string_split(module, '/')[1:n], '/') FOR n IN range(1, len(string_split(module, '/')) + 1)]) AS prefix FROM tgt),
  breadth AS (SELECT prefix, count(*) AS breadth FROM below GROUP BY prefix),
  shares AS (SELECT leaf, module, 1.0::DOUBLE / count(*) OVER (PARTITION BY leaf) AS w FROM (SELECT DISTINCT leaf, module FROM tgt)),
  mass AS (SELECT file, prefix, round(sum(w), 9) AS v FROM (SELECT DISTINCT file, leaf FROM src) JOIN shares USING (leaf) JOIN below USING (module) GROUP BY file, prefix),
  pick AS (SELECT file, prefix, v, row_number() OVER (PARTITION BY file ORDER BY len(string_split(prefix, '/')) DESC, v DESC, breadth, prefix) AS k FROM (SELECT *, max(v) OVER (PARTITION BY file) AS most FROM mass) JOIN breadth USING (prefix) WHERE v >= 0.5 * most),
  fmap AS (SELECT f.file, f.module, CASE WHEN x OR y THEN f.module WHEN v >= 0.5 THEN prefix END AS subtree, CASE WHEN x THEN 'exact' WHEN y THEN 'exact-subtree' WHEN v >= 0.5 THEN 'graph-cluster' END AS method,
    CASE WHEN NOT x AND NOT y AND v >= 0.5 THEN round(v * 100) / 100 END AS votes FROM (SELECT *, module IN (SELECT module FROM tgt) AS x, module IN (SELECT prefix FROM below) AS y FROM (SELECT DISTINCT file, replace(substring(file, 5, length(file) - 7), '-', '_') AS module FROM s0)) f
    LEFT JOIN (SELECT * FROM pick WHERE k = 1) p ON p.file = f.file),
  cand AS (SELECT s.id, 1 AS tier, t.id AS target, t.is_impl FROM src s JOIN tgt t ON t.module = s.module AND t.leaf = s.leaf
    UNION ALL SELECT s.id, 2, t.id, t.is_impl FROM src s JOIN fmap m ON m.file = s.file JOIN tgt t ON t.leaf = s.leaf AND (t.module = m.subtree OR starts_with(t.module, m.subtree || '/'))
    UNION ALL SELECT s.id, 3, t.id, t.is_impl FROM src s JOIN tgt t ON t.leaf = s.leaf AND split_part(t.module, '/', -1) = split_part(s.module, '/', -1)
    UNION ALL SELECT s.id, 4, t.id, t.is_impl FROM src s JOIN tgt t ON t.leaf = s.leaf),
  rep AS (SELECT id, tier, target FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, is_impl, strlen(target), target) AS k FROM (SELECT DISTINCT * FROM cand)) WHERE k = 1),
  matched AS (SELECT s.id, s.file, s.module, s.leaf, CASE r.tier WHEN 1 THEN 'exact-module' WHEN 2 THEN 'subtree' WHEN 3 THEN 'global-name' WHEN 4 THEN 'global-name' ELSE 'unmatched' END AS tier, r.target FROM src s LEFT JOIN rep r USING (id)),
  contrib AS (SELECT m.file, t.file AS target_file, count(*) FILTER (WHERE tier IN ('exact-module', 'subtree')) AS strong_matched, count(*) AS total_matched FROM matched m JOIN tgt t ON t.id = m.target GROUP BY 1, 2),
  per AS (SELECT f.file AS path, f.subtree, f.method, count(m.id) AS total, count(m.target) AS hits, count(*) FILTER (WHERE tier = 'exact-module') AS e, count(*) FILTER (WHERE tier = 'subtree') AS u, count(*) FILTER (WHERE tier = 'global-name') AS g, count(*) FILTER (WHERE tier = 'unmatched') AS n,
    count(t.id) AS resolved, count(*) FILTER (WHERE NOT t.is_primary) AS secondary FROM fmap f LEFT JOIN matched m ON m.file = f.file LEFT JOIN (SELECT DISTINCT id, is_primary FROM tgt) t ON t.id = m.target GROUP BY 1, 2, 3),
  banded0 AS (SELECT *, CASE WHEN path LIKE '%brand-11/size-1%' THEN 'DONE' WHEN total > 0 AND hits::DOUBLE / total >= 0.6 THEN 'PORTED' WHEN hits >= 1 OR subtree IS NOT NULL THEN 'STARTED' ELSE 'NOT-STARTED' END AS b FROM per),
  bands AS (SELECT *, CASE WHEN b IN ('PORTED', 'STARTED') AND resolved > 0 AND secondary * 2 > resolved THEN 'RELOCATED' ELSE b END AS band FROM banded0)"""
_PACKAGED = "rows0 AS (SELECT *, split_part(file, '/', 2) AS package, split_part(target_file, '/', 2) AS target_crate FROM contrib WHERE strong_matched >= 2 OR (total_matched >= 3 AND strong_matched >= 1) OR total_matched >= 4)"
_DELTA = f"""
WITH b AS ({BEFORE}), a AS ({AFTER}), ranks(band, r) AS (VALUES ('NOT-STARTED', 0), ('STARTED', 1), ('RELOCATED', 2), ('PORTED', 3), ('DONE', 4)),
  delta AS (SELECT coalesce(b.package, a.package) AS package, coalesce(b.path, a.path) AS path, b.band AS band_before, a.band AS band_after,
    CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' WHEN y.r > x.r THEN 'advanced' WHEN y.r < x.r THEN 'regressed' ELSE 'unchanged' END AS direction,
    b.coverage AS coverage_before, a.coverage AS coverage_after, round((a.coverage - b.coverage) * 1000) / 1000 AS coverage_delta
  FROM b FULL JOIN a ON a.package = b.package AND a.path = b.path LEFT JOIN ranks x ON x.band = b.band LEFT JOIN ranks y ON y.band = a.band)"""
_NET = ", ".join(f"count(*) FILTER (WHERE band_after = '{b}') - count(*) FILTER (WHERE band_before = '{b}') AS net_{b.lower().replace('-', '_')}" for b in D.BANDS)
_PER_BAND = ", ".join(f"count(*) FILTER (WHERE band = '{b}') AS {b.lower().replace('-', '_')}" for b in D.BANDS)

QUERIES = {
    "port_naming": naming, "port_file_map": file_map, "port_symbol_match": symbol_match, "port_graph_confirm": confirmed, "port_bands": bands, "port_ready_frontier": frontier, "port_file_merges": merges, "port_misplacements": misplaced,
    "port_delta": delta, "port_delta_totals": delta_totals, "port_delta_transitions": delta_transitions, "port_package_totals": package_totals,
}
SQL = {
    "port_naming": ctes(f"""WITH n AS (SELECT DISTINCT concat(CASE p_size % 4 WHEN 0 THEN 'get' WHEN 1 THEN 'HTTPServer' WHEN 2 THEN 'MAX_' ELSE 'kebab-case' END, replace(replace(p_brand, '#', ''), 'Brand', CASE p_size % 3 WHEN 0 THEN 'ID' ELSE 'Name' END), p_size % 7) AS name, concat('src/', lower(p_type), '/My-', p_size, CASE p_size % 3 WHEN 0 THEN '.lazy.tsx' ELSE '.ts' END) AS file, concat('crates/', lower(p_type), '/src/a/b', p_size, CASE p_size % 2 WHEN 0 THEN '/mod.rs' ELSE '.rs' END) AS target FROM {{part}})
SELECT name, {_SNAKE.format("name")} AS snake, regexp_full_match(name, '[A-Z0-9]+(_[A-Z0-9]+)*') AND regexp_matches(name, '[A-Z]') AS screaming, regexp_matches(name, '^[A-Z]') AND regexp_matches(name, '[a-z]') AS pascal, {_LEAF.format("name")} AS leaf, replace(name, '-', '_') AS kebab,
  replace(regexp_replace(substring(file, 5), '([.]lazy)?[.]tsx?$', ''), '-', '_') AS source_module, regexp_replace(regexp_replace(split_part(target, '/src/', 2), '[.]rs$', ''), '/mod$', '') AS target_module FROM n"""),
    "port_file_map": ctes(_CTES + " SELECT * FROM fmap"),
    "port_symbol_match": ctes(_CTES + " SELECT * FROM matched"),
    "port_graph_confirm": ctes(_CTES + f""",
  sc AS (SELECT DISTINCT a.id AS caller, b.id AS callee FROM s0 a JOIN s0 b ON b.k = xor(a.k, 12) OR b.k = a.k + 6), tc AS (SELECT DISTINCT a.id AS caller, t.leaf FROM t0 a JOIN t0 b ON b.k = xor(a.k, 12) OR b.k = a.k + 6 JOIN tgt t ON t.id = b.id),
  asked AS (SELECT m.id, m.target, c.leaf FROM (SELECT DISTINCT id, target FROM matched WHERE target IS NOT NULL) m JOIN sc ON sc.caller = m.id JOIN matched c ON c.id = sc.callee AND c.target IS NOT NULL)
SELECT id, avg(CASE WHEN EXISTS (SELECT 1 FROM tc WHERE tc.caller = asked.target AND tc.leaf = asked.leaf) THEN 1.0 ELSE 0.0 END) AS overlap, avg(CASE WHEN EXISTS (SELECT 1 FROM tc WHERE tc.caller = asked.target AND tc.leaf = asked.leaf) THEN 1.0 ELSE 0.0 END) >= 0.5 AS confirmed FROM asked GROUP BY id"""),
    "port_bands": ctes(_CTES + """, top AS (SELECT file, target_file, total_matched, row_number() OVER (PARTITION BY file ORDER BY total_matched DESC, target_file) AS k FROM contrib)
SELECT path, band, round(hits::DOUBLE / nullif(total, 0) * 1000) / 1000 AS coverage, total AS total_symbols, hits AS matched_symbols, e AS exact_module, u AS subtree, g AS global_name, n AS unmatched, subtree AS mapped_target, method, top.target_file AS dominant_target_file,
  coalesce(top.total_matched, 0) AS dominant_target_symbols FROM bands LEFT JOIN top ON top.file = path AND k = 1""".replace("u AS subtree", "u AS \"subtree\"").replace("subtree AS mapped_target", "bands.subtree AS mapped_target")),
    "port_ready_frontier": ctes(_CTES + f""", links AS ({FILE_LINKS.replace("`", '"')}), fan AS (SELECT "to" AS path, count(*) AS fan_in FROM links WHERE "from" <> "to" GROUP BY 1),
  deps AS (SELECT "from" AS path, count(*) AS dep_count, bool_and(coalesce(band IN ('PORTED', 'DONE'), true)) AS ready FROM links LEFT JOIN bands ON bands.path = "to" WHERE "from" <> "to" GROUP BY 1)
SELECT b.path, b.band, coalesce(fan_in, 0) AS fan_in, coalesce(dep_count, 0) AS dep_count FROM bands b LEFT JOIN deps d ON d.path = b.path LEFT JOIN fan f ON f.path = b.path WHERE b.band NOT IN ('PORTED', 'DONE') AND coalesce(ready, true)"""),
    "port_file_merges": ctes(_CTES + f""", {_PACKAGED} SELECT target_file, count(*) AS contributors, CAST(sum(strong_matched) AS BIGINT) AS strong, string_agg(DISTINCT package, ',' ORDER BY package) AS packages,
  string_agg(file, ',' ORDER BY strong_matched DESC, total_matched DESC, file) AS source_files, count(DISTINCT package) >= 2 AS cross_package FROM rows0 GROUP BY target_file HAVING count(*) >= 2"""),
    "port_misplacements": ctes(_CTES + f""", {_PACKAGED}, own AS (SELECT target_crate, package, row_number() OVER (PARTITION BY target_crate ORDER BY count(*) DESC, package) AS k FROM rows0 GROUP BY 1, 2)
SELECT r.file, r.package AS source_package, r.target_file, r.target_crate, o.package AS owning_package, r.strong_matched, r.total_matched FROM rows0 r JOIN own o ON o.target_crate = r.target_crate AND o.k = 1 WHERE o.package <> r.package"""),
    "port_delta": ctes(_DELTA + " SELECT * FROM delta"),
    "port_delta_totals": ctes(_DELTA + f""" SELECT {", ".join(f"count(*) FILTER (WHERE direction = '{d}') AS {d}" for d in D.DIRECTIONS)}, {_NET},
  CASE WHEN bool_or(direction = 'advanced') AND bool_or(direction = 'regressed') THEN 'mixed' WHEN bool_or(direction = 'advanced') THEN 'forward' WHEN bool_or(direction = 'regressed') THEN 'backward' ELSE 'no-change' END AS verdict FROM delta"""),
    "port_delta_transitions": ctes(_DELTA + " SELECT band_before, band_after, count(*) AS count FROM delta WHERE direction IN ('advanced', 'regressed') GROUP BY 1, 2"),
    "port_package_totals": ctes(f"WITH a AS ({AFTER}) SELECT package, count(*) AS files, {_PER_BAND}, CAST(sum(total_symbols) AS BIGINT) AS symbols_total, CAST(sum(matched_symbols) AS BIGINT) AS symbols_matched, coalesce(round(sum(matched_symbols)::DOUBLE / nullif(sum(total_symbols), 0) * 1000) / 1000, 0.0) AS symbols_pct FROM a GROUP BY package"),
}
