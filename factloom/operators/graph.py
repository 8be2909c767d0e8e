"""Dependency graph of symbols and files: degrees, condensation, layers, rollups, merging and rooting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions.symbols import leaf_name, package_of
from factloom.operators.components import connected_components
from factloom.operators.fixpoint import Rounds, reach, rounds, semi_naive
from factloom.operators.reachability import reach_counts
from factloom.schemas import UNKNOWN
from factloom.storage import forget, shared_table


def _sorted_set(column: str | Column) -> Column:
    return F.array_sort(F.collect_set(column))


def graph_nodes(definitions: DataFrame, edges: DataFrame) -> DataFrame:
    """Definitions and edge ends: (id, display, file, language, line_start, line_end, loc, external)."""
    ends = edges.select(F.col("caller").alias("id")).union(edges.select("callee")).distinct()
    loc = F.greatest(F.col("line_end") - F.col("line_start"), F.lit(0)) + 1
    own = definitions.select("id", "display", "file", "language", "line_start", "line_end", loc.alias("loc"))
    both = ends.join(own.withColumn("internal", F.lit(True)), "id", "full_outer")
    return both.select("id", F.coalesce("display", "id").alias("display"), "file", "language", "line_start", "line_end", "loc", F.col("internal").isNull().alias("external"))


def edge_provenance(edges: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges with provenance: 'unknown' (unresolved, or to an unknown root), 'resolved' (to a definition), else 'external'."""
    unsure = roots.filter(F.col("effect") == UNKNOWN).select(F.col("symbol").alias("callee"), F.lit(True).alias("unsure")).distinct()
    local = nodes.filter("NOT external").select(F.col("id").alias("callee"), F.lit(True).alias("local"))
    met = edges.join(local, "callee", "left").join(unsure, "callee", "left")
    kind = F.when(F.col("local"), F.when(F.col("resolution") == "unresolved", "unknown").otherwise("resolved"))
    kind = kind.when((F.col("resolution") == "unresolved") | F.col("unsure"), "unknown").otherwise("external")
    return met.select(*edges.columns, kind.alias("provenance"))


def dependency_pairs(edges: DataFrame) -> DataFrame:
    """Distinct (caller, callee) of all kinds without self-loops."""
    return edges.filter("caller <> callee").select("caller", "callee").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out, is_leaf, external_packages); a leaf depends on no definition."""
    pairs = dependency_pairs(edges)
    outside = nodes.filter("external").select(F.col("id").alias("callee"), F.lit(True).alias("out"))
    out = pairs.join(outside, "callee", "left").groupBy(F.col("caller").alias("id")).agg(
        F.count("*").alias("fan_out"), F.count_if(F.col("out").isNull()).alias("inner"), _sorted_set(F.when(F.col("out"), package_of(F.col("callee")))).alias("external_packages")
    )
    into = pairs.groupBy(F.col("callee").alias("id")).agg(F.count("*").alias("fan_in"))
    met = nodes.select("id", "external").join(out, "id", "left").join(into, "id", "left")
    none = F.array().cast("array<string>")
    return met.select(
        "id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"),
        (F.coalesce("inner", F.lit(0)) == 0).alias("is_leaf"), F.coalesce("external_packages", none).alias("external_packages"),
    )


def strongly_connected(nodes: DataFrame, pairs: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(id, component) for every node; component is the smallest member.

    Nodes without a dependency or without a dependent inside what remains are trimmed first (they are components by
    themselves); then the smallest id floods forward as a colour, and what reaches a colour's origin within the colour is
    its component.  Both steps repeat on the rest, which shrinks by all origins each time.
    """
    left = shared_table(pairs.select("caller", "callee").filter("caller <> callee").distinct(), "scc-edges")
    done = Rounds("scc-found")
    for _ in rounds(max_rounds):
        # trim until every remaining edge is between nodes that have both directions
        n = left.count()
        while n:
            heads, tails = left.select(F.col("caller").alias("x")).distinct(), left.select(F.col("callee").alias("x")).distinct()
            core = heads.intersect(tails)
            left = shared_table(left.join(core.withColumnRenamed("x", "caller"), "caller", "left_semi").join(core.withColumnRenamed("x", "callee"), "callee", "left_semi"), "scc-edges")
            before, n = n, left.count()
            if before == n:
                break
        if not n:
            break
        colour = shared_table(left.select(F.col("caller").alias("id")).union(left.select("callee")).distinct().withColumn("colour", F.col("id")), "scc-colour")
        for _ in rounds(max_rounds):
            near = left.join(colour, left["caller"] == colour["id"]).groupBy(F.col("callee").alias("id")).agg(F.min("colour").alias("other"))
            now = shared_table(colour.join(near, "id", "left").select("id", F.least("colour", F.coalesce("other", "colour")).alias("colour"), (F.col("other") < F.col("colour")).alias("moved")), "scc-colour")
            colour = now.select("id", "colour")
            if now.filter("moved").isEmpty():
                break
        else:
            raise RuntimeError(f"colours did not settle within {max_rounds} rounds")
        same = left.join(colour.select(F.col("id").alias("caller"), F.col("colour").alias("c1")), "caller").join(colour.select(F.col("id").alias("callee"), F.col("colour").alias("c2")), "callee")
        same = shared_table(same.filter("c1 = c2").select("caller", "callee", F.col("c1").alias("colour")), "scc-same")
        origin = colour.filter("id = colour")

        def back(new: DataFrame, same: DataFrame = same) -> DataFrame:
            return same.join(new.select(F.col("id").alias("callee"), F.col("colour").alias("c")), "callee").filter("c = colour").select(F.col("caller").alias("id"), "colour").distinct()

        found = shared_table(semi_naive(origin, back, ["id", "colour"], max_rounds), "scc-found")
        done.add(found)
        gone = found.select("id")
        left = left.join(gone.withColumnRenamed("id", "caller"), "caller", "left_anti").join(gone.withColumnRenamed("id", "callee"), "callee", "left_anti")
        left = shared_table(left, "scc-edges")
    else:
        raise RuntimeError(f"components not found within {max_rounds} rounds")
    ids = nodes.select("id").distinct()
    if not done.parts:
        return ids.select("id", F.col("id").alias("component"))
    done = done.all()
    low = done.groupBy("colour").agg(F.min("id").alias("component"))
    named = done.join(low, "colour").select("id", "component")
    return ids.join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def layers(nodes: DataFrame, pairs: DataFrame, max_rounds: int | None = None) -> DataFrame | None:
    """(id, wave): 0 without dependencies, else one more than the highest wave it depends on; None if there is a cycle."""
    rest = shared_table(nodes.select("id").distinct(), "layer-rest")
    live = shared_table(pairs.filter("caller <> callee").select("caller", "callee").distinct(), "layer-edges")
    out = Rounds("layer")
    for wave in rounds(max_rounds):
        if rest.isEmpty():
            return out.all() if out.parts else rest.withColumn("wave", F.lit(0))
        ready = shared_table(rest.join(live.select(F.col("caller").alias("id")).distinct(), "id", "left_anti").withColumn("wave", F.lit(wave)), "layer")
        if ready.isEmpty():
            return None
        out.add(ready)
        rest = shared_table(rest.join(ready, "id", "left_anti"), "layer-rest")
        live = shared_table(live.join(ready.select(F.col("id").alias("callee")), "callee", "left_anti").select("caller", "callee"), "layer-edges")
    raise RuntimeError(f"more than {max_rounds} layers")


#: Up to so many edges one task finds components and levels (a few MB); beyond, the distributed rounds do.
SMALL_EDGES = 200_000


def condense_local(pairs: list[tuple], base: dict = {}) -> list[tuple]:  # noqa: B006
    """(id, component, level) of all ends of the pairs, by Tarjan's algorithm without recursion; a node's level is at least its base."""
    out: dict[str, list[str]] = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    of: dict[str, str] = {}
    level: dict[str, int] = {}
    stack: list[str] = []
    for root in sorted(out):
        if root in index:
            continue
        todo = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        while todo:
            x, rest = todo[-1]
            for y in rest:
                if y not in index:
                    index[y] = low[y] = len(index)
                    stack.append(y)
                    todo.append((y, iter(out[y])))
                    break
                if y not in of:
                    low[x] = min(low[x], index[y])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[x])
                if low[x] == index[x]:  # x closes a component; what it depends on is closed already
                    members = [stack.pop()]
                    while members[-1] != x:
                        members.append(stack.pop())
                    name = min(members)
                    of.update(dict.fromkeys(members, name))
                    level[name] = max(max(base.get(m, 0) for m in members), max((level[of[y]] + 1 for m in members for y in out[m] if of[y] != name), default=0))
    return [(x, c, level[c]) for x, c in of.items()]


def _levels(nodes: DataFrame, pairs: DataFrame, small_edges: int) -> DataFrame:
    """(id, component, level) of every node."""
    if pairs.count() <= small_edges:

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(condense_local(list(zip(frame["caller"], frame["callee"]))), columns=["id", "component", "level"])

        found = pairs.filter("caller <> callee").withColumn("all", F.lit(1)).groupBy("all").applyInPandas(run, "id string, component string, level int")
        met = nodes.join(found, "id", "left")
        return met.select("id", F.coalesce("component", "id").alias("component"), F.coalesce("level", F.lit(0)).alias("level"))
    return _levels_by_rounds(nodes, pairs, small_edges)


def _number(ids: DataFrame):  # noqa: ANN202
    """The 64-bit hash of an id, as a function of its column, under the first seed that gives no two ids the same."""
    for seed in rounds(None):
        of = lambda c, seed=seed: F.xxhash64(F.lit(seed), F.col(c))
        if ids.groupBy(of("id").alias("n")).count().filter("count > 1").isEmpty():
            return of


def _peel(state: DataFrame, edges: DataFrame, out: Rounds, small_edges: int) -> tuple[DataFrame, DataFrame]:
    """Levels of nodes without a dependency, then of those that are left without one, until cycles stop it: what remains of (state, edges).

    state(n, deg, top) has each node's dependencies that have no level yet, and its least level by the others; an edge (a, b)
    is met once, when b gets its level.  Edges are written again when half of them are done; as soon as few are left, one
    task does the rest, cycles included.
    """
    left = kept = edges.count()
    while True:
        ready = shared_table(state.filter("deg = 0").select("n", F.col("n").alias("c"), F.col("top").alias("level")), "level")
        few, stuck = 0 < left <= small_edges, ready.isEmpty()
        if left < kept and (few or stuck or left < kept / 2):
            before, kept = edges, left
            edges = shared_table(edges.join(state.select(F.col("n").alias("b")), "b", "left_semi").select("a", "b"), "level-edges")
            forget(before)
        if few:
            out.add(ready)
            out.add(shared_table(_finish(state, edges), "level"))
            return state.limit(0), edges
        if stuck:
            return state, edges
        out.add(ready)
        done = edges.join(ready.select(F.col("n").alias("b"), "level"), "b").groupBy(F.col("a").alias("n")).agg(F.count("*").alias("gone"), (F.max("level") + 1).alias("up"))
        before = state
        state = state.filter("deg > 0").join(done, "n", "left").select("n", (F.col("deg") - F.coalesce("gone", F.lit(0))).alias("deg"), F.greatest("top", F.coalesce("up", F.lit(0))).alias("top"))
        state = shared_table(state, "level-state")
        forget(before)
        left = state.agg(F.sum("deg")).first()[0] or 0


def _finish(state: DataFrame, edges: DataFrame) -> DataFrame:
    """(n, c, level) of the nodes that still have dependencies, in one task."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ready = set(frame["b"]) - set(frame["a"])
        base = dict(zip(frame["a"], frame["top"])) | dict(zip(frame["b"], frame["under"]))
        return pd.DataFrame([r for r in condense_local(list(zip(frame["a"], frame["b"])), base) if r[0] not in ready], columns=["n", "c", "level"])

    met = edges.join(state.select(F.col("n").alias("a"), "top"), "a").join(state.select(F.col("n").alias("b"), F.col("top").alias("under")), "b")
    return met.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(run, "n long, c long, level int")


def _cycles(edges: DataFrame, small_edges: int) -> DataFrame:
    """(n, c) of the nodes of cycles; c is the smallest n of its component.

    What has no dependent is cut off, and the rest falls into weakly connected parts: small ones are gathered in tasks of
    about small_edges edges, large ones take the rounds of strongly_connected().
    """
    core, n = edges, edges.count()
    while n > small_edges:
        smaller = shared_table(core.join(core.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", "b"), "core")
        before, n = n, smaller.count()
        core = smaller
        if n > 0.9 * before:
            break
    part = shared_table(connected_components(core, "a", "b"), "core-parts")
    core = shared_table(core.join(part.select(F.col("node").alias("a"), F.col("component").alias("w")), "a"), "core")
    sizes = core.groupBy("w").agg(F.count("*").alias("size"))
    large = shared_table(sizes.filter(F.col("size") > small_edges).select("w"), "core-large")
    bins = max(1, -(-n * 4 // max(small_edges, 1)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([r[:2] for r in condense_local(list(zip(frame["a"], frame["b"])))], columns=["n", "c"])

    found = core.join(large, "w", "left_anti").withColumn("bin", F.pmod(F.xxhash64("w"), F.lit(bins))).groupBy("bin").applyInPandas(run, "n long, c long")
    if not large.isEmpty():
        rest = core.join(large, "w", "left_semi").select(F.col("a").alias("caller"), F.col("b").alias("callee"))
        ends = rest.select(F.col("caller").alias("id")).union(rest.select("callee")).distinct()
        found = found.unionByName(strongly_connected(ends, rest).select(F.col("id").alias("n"), F.col("component").alias("c")))
    found = shared_table(found, "core-found")
    return found.join(found.filter("n <> c").select("c").distinct(), "c", "left_semi").select("n", "c")


def _levels_by_rounds(nodes: DataFrame, pairs: DataFrame, small_edges: int) -> DataFrame:
    """_levels() of any number of edges: on numbers, from the nodes without dependencies up; where cycles stop it, they are found and become one node each."""
    ids = shared_table(nodes.select("id").union(pairs.select("caller")).union(pairs.select("callee")).distinct(), "level-ids")
    of = _number(ids)
    edges = shared_table(pairs.filter("caller <> callee").select(of("caller").alias("a"), of("callee").alias("b")), "level-edges")
    degree = edges.groupBy(F.col("a").alias("n")).agg(F.count("*").alias("deg"))
    state = ids.select(of("id").alias("n")).join(degree, "n", "left").select("n", F.coalesce("deg", F.lit(0)).alias("deg"), F.lit(0).alias("top"))
    out = Rounds("levels")
    state, edges = _peel(shared_table(state, "level-state"), edges, out, small_edges)
    at = None
    if not state.isEmpty():
        at = shared_table(_cycles(edges, small_edges), "cycles")
        to = lambda c: at.select(F.col("n").alias(c), F.col("c").alias(c + "_c"))
        lifted = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b")).filter("a <> b").distinct()
        lifted = shared_table(lifted, "level-edges")
        forget(edges)
        degree = lifted.groupBy(F.col("a").alias("n")).agg(F.count("*").alias("deg"))
        state = state.join(to("n"), "n", "left").groupBy(F.coalesce("n_c", "n").alias("n")).agg(F.max("top").alias("top"))
        state = state.join(degree, "n", "left").select("n", F.coalesce("deg", F.lit(0)).alias("deg"), "top")
        _peel(shared_table(state, "level-state"), lifted, out, small_edges)
    found = out.all()
    if at is not None:  # members of a cycle have the level of the node that it became
        found = found.select(F.col("n").alias("c0"), F.col("c").alias("c1"), "level").join(at.select("n", F.col("c").alias("c0")), "c0", "left").select(F.coalesce("n", "c0").alias("n"), F.col("c1").alias("c"), "level")
    found = shared_table(ids.select("id", of("id").alias("n")).join(found, "n"), "levels")
    several = found.join(found.filter("n <> c").select("c").distinct(), "c", "left_semi").groupBy("c").agg(F.min("id").alias("component"))
    named = found.join(several, "c", "left").select("id", F.coalesce("component", "id").alias("component"), "level")
    return nodes.select("id").join(named, "id")


def condensation(nodes: DataFrame, pairs: DataFrame, small_edges: int = SMALL_EDGES) -> DataFrame:
    """(id, component, size, scc, level): dependencies first by (level, smallest member, id).

    scc is 'scc:N' in that order for components of several members, else null.
    """
    nodes, pairs = shared_table(nodes.select("id").distinct(), "nodes"), shared_table(pairs.select("caller", "callee").distinct(), "pairs")
    comp = shared_table(_levels(nodes, pairs, small_edges), "components")
    sized = comp.groupBy("component").agg(F.count("*").alias("size"), F.first("level").alias("level"))
    # numbered per component of several members: few rows
    named = sized.filter("size > 1").withColumn("n", F.row_number().over(W.orderBy("level", "component")) - 1).select("component", F.concat(F.lit("scc:"), F.col("n").cast("string")).alias("scc"))
    return comp.select("id", "component").join(sized, "component").join(named, "component", "left").select("id", "component", "size", "scc", "level")


def topological_order(condensed: DataFrame) -> DataFrame:
    """Condensation rows in dependencies-first order, members of a component together."""
    return condensed.orderBy("level", "component", "id")


def transitive_counts(pairs: DataFrame, small_edges: int = SMALL_EDGES) -> DataFrame:
    """(id, transitive_dep_count): nodes reachable other than itself; the pairs themselves are never a table."""
    pairs = shared_table(pairs.select("caller", "callee").filter("caller <> callee").distinct(), "pairs")
    nodes = shared_table(pairs.select(F.col("caller").alias("id")).union(pairs.select("callee")).distinct(), "nodes")
    return reach_counts(_levels(nodes, pairs, small_edges), pairs).filter("n > 0").select("id", F.col("n").alias("transitive_dep_count"))


def symbol_sets(definitions: DataFrame, edges: DataFrame, summaries: DataFrame) -> DataFrame:
    """What file_rollup() needs of the symbol table: (id, file, loc, external, effect_roots, external_packages) of the definitions."""
    own = definitions.select("id", "file", (F.greatest(F.col("line_end") - F.col("line_start"), F.lit(0)) + 1).alias("loc"), F.lit(False).alias("external"))
    ends = edges.filter("caller <> callee").select(F.col("callee").alias("id")).distinct()
    outside = ends.join(definitions.select("id"), "id", "left_anti").withColumnRenamed("id", "callee")
    packages = edges.filter("caller <> callee").join(outside, "callee").groupBy(F.col("caller").alias("id")).agg(_sorted_set(package_of(F.col("callee"))).alias("external_packages"))
    effects = summaries.groupBy(F.col("symbol").alias("id")).agg(_sorted_set("effect").alias("effect_roots"))
    none = F.array().cast("array<string>")
    met = own.join(effects, "id", "left").join(packages, "id", "left")
    return met.withColumn("effect_roots", F.coalesce("effect_roots", none)).withColumn("external_packages", F.coalesce("external_packages", none))


def file_rollup(symbols: DataFrame) -> DataFrame:
    """(path, symbol_count, loc, effect_roots, external_packages) from symbols with effect_roots and external_packages."""
    own = symbols.filter("NOT external AND file IS NOT NULL").groupBy(F.col("file").alias("path")).agg(
        F.count("*").alias("symbol_count"), F.sum(F.coalesce("loc", F.lit(0))).alias("loc"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("effect_roots")))).alias("effect_roots"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("external_packages")))).alias("external_packages"),
    )
    return own


def file_edges(definitions: DataFrame, edges: DataFrame) -> DataFrame:
    """(from, to, call_edge_count, has_unknown): edges between definitions of different files, not distinct."""
    at = definitions.select("id", "file")
    met = edges.join(at.select(F.col("id").alias("caller"), F.col("file").alias("from")), "caller").join(at.select(F.col("id").alias("callee"), F.col("file").alias("to")), "callee")
    return met.filter("`from` <> `to`").groupBy("from", "to").agg(F.count("*").alias("call_edge_count"), F.bool_or(F.col("resolution") == "unresolved").alias("has_unknown"))


def symbol_table(definitions: DataFrame, edges: DataFrame, summaries: DataFrame, transitive: bool = False) -> DataFrame:
    """The graph's symbols with degrees, effects, packages and cycle ids."""
    edges = shared_table(edges, "graph-edges")
    nodes = shared_table(graph_nodes(definitions, edges), "graph-nodes")
    effects = summaries.groupBy(F.col("symbol").alias("id")).agg(_sorted_set("effect").alias("effect_roots"))
    internal = nodes.filter("NOT external")
    pairs = dependency_pairs(edges)
    inner = pairs.join(internal.select(F.col("id").alias("caller")), "caller", "left_semi").join(internal.select(F.col("id").alias("callee")), "callee", "left_semi")
    cycles = condensation(internal, inner).filter("scc IS NOT NULL").select("id", "scc")
    out = nodes.join(degrees(nodes, edges), "id").join(effects, "id", "left").join(cycles, "id", "left")
    out = out.withColumn("effect_roots", F.coalesce("effect_roots", F.array().cast("array<string>")))
    if transitive:
        out = out.join(transitive_counts(pairs), "id", "left").withColumn("transitive_dep_count", F.coalesce("transitive_dep_count", F.lit(0)))
    return out


def graph_stats(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    one = symbols.agg(F.count_if(~F.col("external")).alias("symbols"), F.count_if("external").alias("external_symbols"), F.countDistinct("file").alias("files"), F.countDistinct("scc").alias("cycles"))
    return one.crossJoin(edges.agg(F.count("*").alias("edges")))


def resolve_pattern(symbols: DataFrame, pattern: str) -> DataFrame:
    """(id) of the first tier that matches: exact id; id suffix, display or leaf; id substring; file (exact or substring)."""
    p, ident = F.lit(pattern), F.col("id")
    tier = F.when(ident == p, 1).when(ident.endswith(p) | (F.col("display") == p) | (leaf_name(ident) == p), 2).when(ident.contains(p), 3)
    tier = tier.when(F.coalesce(F.col("file").contains(p), F.lit(False)), 4)
    met = symbols.select("id", tier.alias("tier")).filter("tier IS NOT NULL")
    best = met.agg(F.min("tier").alias("best"))
    return met.join(F.broadcast(best), F.expr("tier = best")).select("id", "tier")  # one row


def near_misses(symbols: DataFrame, pattern: str, n: int = 5) -> DataFrame:
    """Up to n ids for error messages: those with the pattern in id or display, in any case; without one, the first internal ones."""
    part = F.lit(pattern.lower())
    like = F.lower("id").contains(part) | F.coalesce(F.lower("display").contains(part), F.lit(False))
    met = symbols.select("id", F.when(like, 1).when(~F.col("external"), 2).alias("tier")).filter("tier IS NOT NULL")
    best = met.agg(F.min("tier").alias("best"))
    return met.join(F.broadcast(best), F.expr("tier = best")).select("id").orderBy("id").limit(n)  # one row


def closure_of(symbols: DataFrame, edges: DataFrame, start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, edges) reachable from start over all edge kinds; effects are carried over, degrees are to be recomputed."""
    inside = shared_table(reach(edges, start).select("id"), "closure")
    keep = symbols.join(inside, "id", "left_semi")
    near = edges.join(inside.select(F.col("id").alias("caller")), "caller", "left_semi").join(inside.select(F.col("id").alias("callee")), "callee", "left_semi")
    return keep, near.select(*edges.columns)


def merge_graphs(symbols: DataFrame, edges: DataFrame, by: str = "graph") -> tuple[DataFrame, DataFrame]:
    """Union of graphs numbered in column `by`: per id the first internal row, else the first; edges once per evidence."""
    w = W.partitionBy("id").orderBy(F.col("external").cast("int"), by)
    nodes = symbols.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", by)
    first = W.partitionBy("caller", "callee", "kind", "evidence_file", "evidence_line").orderBy(by, "resolution")
    links = edges.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", by)
    return nodes, links


def append_graphs(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Plain concatenation, for graphs whose ids can't clash."""
    for o in others:
        first = first.unionByName(o, allowMissingColumns=True)
    return first


def reroot(symbols: DataFrame, edges: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """The part under a directory: internal symbols with the prefix cut from file and id; edges that leave it are dropped."""
    p = prefix.rstrip("/") + "/"
    inside = symbols.filter(~F.col("external") & F.col("file").startswith(p))
    cut = lambda c: F.when(F.col(c).startswith(p), F.substring(F.col(c), len(p) + 1, 1 << 20)).otherwise(F.col(c))
    ids = inside.select("id")
    near = edges.join(ids.withColumnRenamed("id", "caller"), "caller", "left_semi").join(ids.withColumnRenamed("id", "callee"), "callee", "left_semi")
    return inside.withColumn("id", cut("id")).withColumn("file", cut("file")), near.withColumn("caller", cut("caller")).withColumn("callee", cut("callee")).withColumn("evidence_file", cut("evidence_file"))


def enclosing_definition(sites: DataFrame, definitions: DataFrame, bucket: int = 64) -> DataFrame:
    """sites(file, line, ...) with `owner`: the innermost definition around the line, else '<module>@file'.

    A range join by line buckets: a definition is listed in each bucket it spans, a site looks into its own.  Ties of
    equal spans go to the smaller id.
    """
    spans = definitions.filter("line_end >= line_start").select("id", "file", "line_start", "line_end", F.explode(F.sequence(F.expr(f"line_start div {bucket}"), F.expr(f"line_end div {bucket}"))).alias("b"))
    keyed = sites.withColumn("b", F.expr(f"line div {bucket}"))
    met = keyed.select("file", "line", "b").distinct().join(spans, ["file", "b"]).filter("line BETWEEN line_start AND line_end")
    best = met.groupBy("file", "line").agg(F.min_by("id", F.struct(F.col("line_end") - F.col("line_start"), "id")).alias("owner"))
    return sites.join(best, ["file", "line"], "left").withColumn("owner", F.coalesce("owner", F.concat(F.lit("<module>@"), "file")))
