"""Program facts derived from the test tables, written once for Spark and for DuckDB.

The tables hold no program facts, so every query derives them by fixed rules: customers, parts and suppliers are
definitions, order lines are calls and references, nations decide which outside operation a supplier calls.  A view is
one SQL text with {table} and {view} holes; `frame` fills them with DataFrames, `ctes` with names of earlier CTEs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

VIEWS: dict[str, str] = {
    "v_defs": """
SELECT concat('crm::C', c_custkey) AS id, c_name AS display, 'rust' AS language, concat('crates/crm/src/', lower(c_mktsegment), '.rs') AS file,
    CAST(c_custkey % 200 + 1 AS INT) AS line_start, CAST(c_custkey % 200 + c_custkey % 37 AS INT) AS line_end, c_custkey % 5 = 0 AS is_component FROM {customer}
UNION ALL SELECT concat('cat::P', p_partkey), p_name, 'rust', concat('crates/cat/src/', lower(replace(p_brand, '#', '')), '.rs'),
    CAST(p_partkey % 300 + 1 AS INT), CAST(p_partkey % 300 + p_size AS INT), p_partkey % 7 = 0 FROM {part}
UNION ALL SELECT concat('sup::S', s_suppkey), s_name, 'rust', concat('crates/sup/src/adapters/n', s_nationkey, '.rs'),
    CAST(s_suppkey % 50 + 1 AS INT), CAST(s_suppkey % 50 + 20 AS INT), false FROM {supplier}""",
    "v_edges": """
SELECT caller, callee, kind, CASE WHEN kind = 'reference' THEN 'reference' WHEN callee LIKE 'ext::%' AND length(caller) % 3 = 0 THEN 'unresolved' ELSE 'call' END AS resolution,
    concat(substring(caller, 1, 3), '.rs') AS evidence_file, CAST(length(caller) * 10 + length(callee) AS INT) AS evidence_line,
    kind = 'call' AND length(caller) % 4 = 1 AS seam
FROM (SELECT concat('crm::C', o_custkey) AS caller, concat('cat::P', l_partkey) AS callee, 'call' AS kind
        FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey
    UNION SELECT concat('cat::P', l_partkey), concat('sup::S', l_suppkey), 'reference' FROM {lineitem}
    UNION SELECT concat('cat::P', a.p_partkey), concat('cat::P', b.p_partkey), 'call' FROM {part} a JOIN {part} b
        ON b.p_partkey = a.p_partkey + 1 - 2 * (a.p_partkey % 2)
    UNION SELECT concat('cat::P', p_partkey), concat('sup::S', p_partkey % 10 + 1), 'type' FROM {part}
    UNION SELECT concat('sup::S', s_suppkey), CASE WHEN s_suppkey % 3 = 0 THEN concat('ext::op', s_nationkey % 8, '::run') ELSE concat('lib', s_nationkey % 5, '::util::f') END, 'call' FROM {supplier}) e""",
    "v_roots": """
SELECT DISTINCT callee AS symbol, CASE substring(callee, 8, 1) WHEN '0' THEN 'fs' WHEN '1' THEN 'net' WHEN '2' THEN 'db' WHEN '3' THEN 'clock'
    WHEN '4' THEN 'random' WHEN '5' THEN 'process' WHEN '6' THEN 'env' ELSE 'alloc' END AS effect FROM {v_edges} WHERE callee LIKE 'ext::op%'""",
    "v_files": """
SELECT d.file AS a, e.file AS b, count(*) AS n FROM {v_edges} x JOIN {v_defs} d ON x.caller = d.id JOIN {v_defs} e ON x.callee = e.id WHERE d.file <> e.file GROUP BY d.file, e.file""",
}


#: What Spark runs instead of a view's text, with the same rows: the branches of the edges differ in their prefixes or kinds, so
#: each is made distinct by itself, on the keys before they become text (a third of the bytes to shuffle).
SPARK_VIEWS: dict[str, str] = {
    "v_edges": VIEWS["v_edges"][: VIEWS["v_edges"].index("FROM (SELECT concat('crm::C'")] + """
FROM (SELECT concat('crm::C', c) AS caller, concat('cat::P', p) AS callee, 'call' AS kind FROM (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey)
    UNION ALL SELECT concat('cat::P', p), concat('sup::S', s), 'reference' FROM (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM {lineitem})
    UNION ALL SELECT concat('cat::P', p), concat('cat::P', q), 'call' FROM (SELECT DISTINCT a.p_partkey AS p, b.p_partkey AS q FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 1 - 2 * (a.p_partkey % 2))
    UNION ALL SELECT concat('cat::P', p), concat('sup::S', p % 10 + 1), 'type' FROM (SELECT DISTINCT p_partkey AS p FROM {part})
    UNION ALL SELECT DISTINCT concat('sup::S', s_suppkey), CASE WHEN s_suppkey % 3 = 0 THEN concat('ext::op', s_nationkey % 8, '::run') ELSE concat('lib', s_nationkey % 5, '::util::f') END, 'call' FROM {supplier}) e""",
}


def _needs(text: str, seen: dict[str, None]) -> None:
    for v, sql in VIEWS.items():
        if "{" + v + "}" in text and v not in seen:
            _needs(sql, seen)
            seen[v] = None


def frame(spark: SparkSession, sf_dir: str, text: str, **given: DataFrame) -> DataFrame:
    """The rows of an SQL text with holes for tables and views (or of a view, by name); views that are `given` aren't derived again."""
    text = SPARK_VIEWS.get(text, VIEWS.get(text, text))
    holes: dict[str, DataFrame] = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    holes |= {v: given[v] if v in given else frame(spark, sf_dir, v, **given) for v in VIEWS if "{" + v + "}" in text}
    return spark.sql(text, **holes)


def ctes(text: str, recursive: bool = False) -> str:
    """DuckDB SQL: the views that `text` needs as CTEs before it. `text` starts with its own CTEs or with SELECT."""
    seen: dict[str, None] = {}
    _needs(text, seen)
    names = {t: t for t in TABLES} | {v: v for v in VIEWS}
    with_ = [f"{v} AS ({_fill(VIEWS[v], names)})" for v in seen]
    body = _fill(text, names).strip()
    if body.upper().startswith("WITH"):
        with_.append(body[4:].strip())
        body = ""
    if not with_:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(with_) + "\n" + body


def _fill(text: str, names: dict[str, str]) -> str:
    for k, v in names.items():
        text = text.replace("{" + k + "}", v)
    return text
