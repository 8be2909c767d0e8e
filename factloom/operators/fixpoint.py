"""Recursion over relations: one semi-naive driver, and the closures that use it.

Spark's recursive CTEs have bag semantics and level limits, so a cyclic graph needs this loop: each round joins only the
rows that are new since the last one, and drops what is known already.  Every round's new rows are a table in the shared
folder, so plans stay as small as one round.  The loop ends when a round brings nothing, however many it
takes; a caller may set a bound, at which it raises.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.schemas import EDGE_KINDS
from factloom.storage import shared_table

MERGE = 8


def rounds(most: int | None) -> Iterable[int]:
    return count() if most is None else range(most)


class Rounds:
    """The rows of many rounds in few tables: MERGE tables of as many rounds each become one, so a row is rewritten log(rounds) times."""

    def __init__(self, name: str):
        self.name, self.parts = name, []

    def add(self, rows: DataFrame) -> None:
        self.parts.append((1, rows))
        while len(self.parts) >= MERGE and self.parts[-1][0] == self.parts[-MERGE][0]:
            last, self.parts = self.parts[-MERGE:], self.parts[:-MERGE]
            self.parts.append((MERGE * last[0][0], shared_table(reduce(DataFrame.unionByName, [t for _, t in last]), self.name)))

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [t for _, t in self.parts])


def semi_naive(seed: DataFrame, step: Callable[[DataFrame], DataFrame], key: list[str], max_rounds: int | None = None) -> DataFrame:
    """Least fixpoint of seed and step, set semantics on `key`; of rows with one key, the round that was first wins.

    `step` gets the newest rows and returns candidates, at most one per key.
    """
    new = shared_table(seed, "fix-new")
    known = Rounds("fix-known")
    known.add(new)
    for _ in rounds(max_rounds):
        if new.isEmpty():
            return known.all()
        new = shared_table(step(new).join(known.all().select(*key), key, "left_anti"), "fix-new")
        known.add(new)
    raise RuntimeError(f"no fixpoint within {max_rounds} rounds")


def carries_effects(edges: DataFrame) -> DataFrame:
    """Calls and references; type edges don't carry effects."""
    return edges.filter(F.col("kind").isin("call", "reference"))


#: So many effects go through the rounds together, as the bits of one long.
MASK_BITS = 60


def effect_closure(edges: DataFrame, roots: DataFrame, max_rounds: int | None = None, paths: bool = True) -> DataFrame:
    """(symbol, effect, path): each effect a symbol reaches and a shortest evidence path from it to a root.

    Both ends are in the path; a root's own path is itself.  Of equally short paths the one whose next hop is the
    smallest is taken, at every hop.  A round sends one row over each edge whose callee is new: the callee and the bits of
    its new effects.  Paths are put together from the next hops, per symbol; without `paths` the column is left out.
    """
    uses = carries_effects(edges)
    uses = uses if hasattr(edges, "shared_path") else shared_table(uses.select("caller", "callee"), "uses")
    uses = uses.select("caller", "callee").filter("caller IS NOT NULL AND callee IS NOT NULL")
    names = sorted((r[0] for r in roots.select("effect").distinct().collect()), key=lambda e: (e is not None, e))  # a vocabulary
    groups = [names[i : i + MASK_BITS] for i in range(0, len(names), MASK_BITS)] or [[]]
    return reduce(DataFrame.unionByName, [_closure(uses, roots, g, max_rounds, paths) for g in groups])


def _closure(uses: DataFrame, roots: DataFrame, names: list[str], max_rounds: int | None, paths: bool) -> DataFrame:
    bits = roots.sparkSession.createDataFrame([(e, 1 << i) for i, e in enumerate(names)], "name string, bit long")
    met = roots.join(F.broadcast(bits), F.col("effect").eqNullSafe(F.col("name")))  # a row per effect
    new = shared_table(met.groupBy("symbol").agg(F.bit_or("bit").alias("mask")), "closure-new")
    rows = lambda t: t.select("symbol", "mask", F.explode(F.array(*[F.struct(F.lit(e).cast("string").alias("effect"), F.lit(1 << i).alias("bit"), (F.col(f"next{i}") if paths and f"next{i}" in t.columns else F.lit(None).cast("string")).alias("next")) for i, e in enumerate(names)])).alias("x")).filter("mask & x.bit <> 0").select("symbol", "x.effect", "x.next") if names else t.select("symbol", F.lit("").alias("effect"), F.lit(None).cast("string").alias("next"))
    out, known = Rounds("closure"), new
    out.add(shared_table(rows(new).select("symbol", "effect", F.array("symbol").alias("path")), "closure") if paths else new)
    last = out.parts[0][1]
    for _ in rounds(max_rounds):
        if new.isEmpty():
            return out.all() if paths else rows(known).select("symbol", "effect")
        sent = uses.join(new.select(F.col("symbol").alias("callee"), "mask"), "callee")
        had = known.select(F.col("symbol").alias("caller"), F.col("mask").alias("had"))
        fresh = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long"))))
        if paths:
            gain = sent.join(had, "caller", "left").select("caller", "callee", fresh.alias("mask")).filter("mask <> 0")
            hops = [F.min(F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.col("callee"))).alias(f"next{i}") for i in range(len(names))]
            gain = gain.groupBy("caller").agg(F.bit_or("mask").alias("mask"), *hops)
        else:
            gain = sent.groupBy("caller").agg(F.bit_or("mask").alias("mask")).join(had, "caller", "left").select("caller", fresh.alias("mask")).filter("mask <> 0")
        new = shared_table(gain.withColumnRenamed("caller", "symbol"), "closure-new")
        if paths:
            far = last.select(F.col("symbol").alias("next"), "effect", F.col("path").alias("rest"))
            last = shared_table(rows(new).join(far, ["next", "effect"]).select("symbol", "effect", F.concat(F.array("symbol"), "rest").alias("path")), "closure")
            out.add(last)
        both = known.select("symbol", "mask").unionByName(new.select("symbol", "mask")).groupBy("symbol").agg(F.bit_or("mask").alias("mask"))
        known = shared_table(both, "closure-known")
    raise RuntimeError(f"no fixpoint within {max_rounds} rounds")


def reach(edges: DataFrame, start: DataFrame, kinds: tuple[str, ...] = EDGE_KINDS, max_rounds: int | None = None) -> DataFrame:
    """(id, hops) of everything reachable from the ids in `start`, over the given edge kinds, outside symbols included."""
    uses = shared_table(edges.filter(F.col("kind").isin(*kinds)).select("caller", "callee").distinct(), "uses")
    seed = start.select("id").distinct().withColumn("hops", F.lit(0))

    def step(new: DataFrame) -> DataFrame:
        return uses.join(new, uses["caller"] == new["id"]).groupBy("callee").agg((F.min("hops") + 1).alias("hops")).withColumnRenamed("callee", "id")

    return semi_naive(seed, step, ["id"], max_rounds)


def reach_pairs(edges: DataFrame, a: str = "caller", b: str = "callee", max_rounds: int | None = None) -> DataFrame:
    """(src, dst): dst is reachable from src by one edge or more. The result is as large as the closure."""
    uses = shared_table(edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).distinct(), "uses")

    def step(new: DataFrame) -> DataFrame:
        more = uses.select(F.col("src").alias("mid"), F.col("dst").alias("far"))
        return new.join(more, new["dst"] == more["mid"]).select("src", F.col("far").alias("dst")).distinct()

    return semi_naive(uses, step, ["src", "dst"], max_rounds)
