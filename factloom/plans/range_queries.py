"""Queries on numeric ranges: measured intervals, and function bodies made from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions import intervals as I
from factloom.operators import ranges as R
from factloom.views import ctes, frame


def interval_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of quantity and discounted balance per part, and what arithmetic makes of them."""
    rows = frame(spark, sf_dir, "SELECT l_partkey AS part, min(l_quantity) - 25 AS a, max(l_quantity) - 25 AS b, min(l_discount) AS c, max(l_discount) AS d FROM {lineitem} GROUP BY l_partkey")
    rows = rows.select("part", F.struct(F.col("a").alias("lower"), F.col("b").alias("upper")).alias("x"), F.struct(F.col("c").alias("lower"), F.col("d").alias("upper")).alias("y"))
    x, y = F.col("x"), F.col("y")
    out = [rows["part"]]
    for name, z in (("sum", I.column_add(x, y)), ("difference", I.column_sub(x, y)), ("product", I.column_mul(x, y)), ("quotient", I.column_div(y, x)), ("cover", I.column_join(x, y))):
        out += [F.round(z["lower"], 9).alias(name + "_lower"), F.round(z["upper"], 9).alias(name + "_upper")]
    return rows.select(*out, I.column_includes_zero(x).alias("may_be_zero"))


_LOCAL = '{"kind":"Local","local":%d}'
_CONST = '{"kind":"Const","value":{"ty":"Int","v":"%s"}}'


def _binary(place: int, kind: str, left: str, right: str, line: int = 1) -> str:
    return f'{{"place":{place},"rvalue":{{"op":"Binary","kind":"{kind}","left":{left},"right":{right}}},"loc":{{"file":"f.rs","line":{line},"col":1}}}}'


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One function per part; its shape depends on the size: plain division, guarded one, by a constant, remainder of a difference, a loop."""
    local, const = (lambda n: _LOCAL % n), (lambda v: _CONST % v)
    back = '"terminator":{"kind":"Return"}'
    plain = '[{"stmts":[' + _binary(0, "Div", local(1), local(2), 3) + "]," + back + "}]"
    guarded = '[{"stmts":[' + _binary(3, "Eq", local(2), const("0")) + '],"terminator":{"kind":"SwitchInt","discr":' + local(3) + ',"targets":[{"value":0,"block":1}],"otherwise":2}},{"stmts":[' + _binary(0, "Div", local(1), local(2), 5) + "]," + back + '},{"stmts":[],' + back + "}]"
    by_const = '[{"stmts":[' + _binary(0, "Div", local(1), const("@K"), 2) + "]," + back + "}]"
    remainder = '[{"stmts":[' + _binary(3, "Sub", local(2), const("@K"), 1) + "," + _binary(0, "Rem", local(1), local(3), 2) + "]," + back + "}]"
    loop = (
        '[{"stmts":[{"place":3,"rvalue":{"op":"Use","operand":' + const("1") + '},"loc":{"file":"f.rs","line":1,"col":1}}],"terminator":{"kind":"Goto","block":1}},{"stmts":[' + _binary(0, "Lt", local(3), const("@K"))
        + '],"terminator":{"kind":"SwitchInt","discr":' + local(0) + ',"targets":[{"value":0,"block":3}],"otherwise":2}},{"stmts":[' + _binary(3, "Add", local(3), const("1")) + '],"terminator":{"kind":"Goto","block":1}},{"stmts":[' + _binary(0, "Div", local(1), local(3), 9) + "]," + back + "}]"
    )
    parts = frame(spark, sf_dir, "SELECT p_partkey AS k, p_size AS s FROM {part}")
    shape = F.element_at(F.array(*[F.lit(x) for x in (plain, guarded, by_const, remainder, loop)]), (F.col("k") % 5 + 1).cast("int"))
    blocks = F.replace(shape, F.lit("@K"), (F.col("s") + 1).cast("string"))
    text = F.concat(F.lit('{"id":"cat::P'), F.col("k").cast("string"), F.lit('","display":"f","file":"f.rs","line":1,"arg_count":2,"locals":[{"kind":"int"},{"kind":"int"},{"kind":"int"},{"kind":"int"}],"blocks":'), blocks, F.lit("}"))
    return parts.select(F.from_json(text, schemas.struct(schemas.BODY)).alias("b")).select("b.*")


def hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hazards(R.function_ranges(bodies(spark, sf_dir)))


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.function_ranges(bodies(spark, sf_dir)).select("id", F.array_join("requires", "; ").alias("requires"), "ensures", F.size("hazards").alias("n_hazards"))


_DIVISOR = "integer (any)"
QUERIES = {"interval_arithmetic": interval_arithmetic, "range_hazards": hazards, "range_functions": ranges}
SQL = {
    "interval_arithmetic": ctes("""
WITH r AS (SELECT l_partkey AS part, min(l_quantity) - 25 AS a, max(l_quantity) - 25 AS b, min(l_discount) AS c, max(l_discount) AS d FROM {lineitem} GROUP BY l_partkey)
SELECT part, round(a + c, 9) AS sum_lower, round(b + d, 9) AS sum_upper, round(a - d, 9) AS difference_lower, round(b - c, 9) AS difference_upper, round(least(a * c, a * d, b * c, b * d), 9) AS product_lower, round(greatest(a * c, a * d, b * c, b * d), 9) AS product_upper,
  CASE WHEN a > 0 OR b < 0 THEN round(least(c / a, c / b, d / a, d / b), 9) END AS quotient_lower, CASE WHEN a > 0 OR b < 0 THEN round(greatest(c / a, c / b, d / a, d / b), 9) END AS quotient_upper,
  round(least(a, c), 9) AS cover_lower, round(greatest(b, d), 9) AS cover_upper, a <= 0 AND b >= 0 AS may_be_zero FROM r"""),
    "range_hazards": ctes(f"""SELECT concat('cat::P', p_partkey) AS function, CASE WHEN p_partkey % 5 = 0 THEN 'divide-by-zero' ELSE 'remainder-by-zero' END AS kind, 'f.rs' AS file, CAST(CASE WHEN p_partkey % 5 = 0 THEN 3 ELSE 2 END AS INTEGER) AS line, 1 AS "column",
  '{_DIVISOR}' AS divisor_range, 'integer ' || CASE WHEN p_partkey % 5 = 0 THEN 'division' ELSE 'remainder' END || ' can panic: the divisor may be zero (range: {_DIVISOR})' AS message FROM {{part}} WHERE p_partkey % 5 IN (0, 3)"""),
}
