"""Work plan over the file graph: groups that must move together, and waves in which groups can move in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.operators.graph import condensation
from factloom.storage import shared_table

MAX_GROUP_LOC = 200


def group_links(file_edges: DataFrame, group_of: DataFrame) -> DataFrame:
    """Distinct (caller, callee) between groups."""
    at = group_of.select("path", "group")
    met = file_edges.join(at.select(F.col("path").alias("from"), F.col("group").alias("caller")), "from").join(at.select(F.col("path").alias("to"), F.col("group").alias("callee")), "to")
    return met.filter("caller <> callee").select("caller", "callee").distinct()


def initial_groups(files: DataFrame, file_edges: DataFrame) -> DataFrame:
    """(path, group, is_cycle): a cycle of files is one group, named by its smallest path; others are alone."""
    cond = condensation(files.select(F.col("path").alias("id")), file_edges.select(F.col("from").alias("caller"), F.col("to").alias("callee")))
    return cond.select(F.col("id").alias("path"), F.col("component").alias("group"), (F.col("size") > 1).alias("is_cycle"))


def coalesce_small(groups: list[tuple[str, str, bool, int]], deps: list[tuple[str, str]], max_loc: int) -> dict[str, str]:
    """path -> group after greedy merging. The order of merges decides the result, so it runs on the driver, over files.

    The small group with the smallest path merges with its neighbour of smallest path whose union stays under max_loc
    and keeps the group graph acyclic; then all starts again.  Two neighbours may merge without a cycle exactly if no
    longer path joins them, which one search answers.
    """
    members: dict[str, set[str]] = {}
    loc: dict[str, int] = {}
    for path, group, _, n in groups:
        members.setdefault(group, set()).add(path)
        loc[group] = loc.get(group, 0) + n
    of = {p: g for g, ps in members.items() for p in ps}
    out: dict[str, set[str]] = {g: set() for g in members}
    into: dict[str, set[str]] = {g: set() for g in members}
    for a, b in deps:
        x, y = of[a], of[b]
        if x != y:
            out[x].add(y)
            into[y].add(x)

    def detour(a: str, b: str) -> bool:
        """Is there a path from a to b besides the edge a -> b?"""
        todo, seen = [x for x in out[a] if x != b], set()
        while todo:
            x = todo.pop()
            if x == b:
                return True
            if x not in seen:
                seen.add(x)
                todo.extend(out[x])
        return False

    first = {g: min(ps) for g, ps in members.items()}
    while True:
        chosen = None
        for g in sorted((g for g in members if loc[g] < max_loc), key=first.get):
            for h in sorted(out[g] | into[g], key=first.get):
                if loc[g] + loc[h] < max_loc and not detour(g, h) and not detour(h, g):
                    chosen = g, h
                    break
            if chosen:
                break
        if not chosen:
            return {p: first[g] for g, ps in members.items() for p in ps}
        g, h = chosen
        members[g] |= members.pop(h)
        loc[g] += loc.pop(h)
        first[g] = min(first[g], first.pop(h))
        for near, far in ((out, into), (into, out)):
            for x in near.pop(h):
                far[x].discard(h)
                if x != g:
                    near[g].add(x)
                    far[x].add(g)
        out[g].discard(g), into[g].discard(g), out[g].discard(h), into[g].discard(h)


def plan_groups(files: DataFrame, file_edges: DataFrame, max_group_loc: int = MAX_GROUP_LOC, coalesce: bool = False) -> DataFrame:
    """Groups in public order: (id, number, reason, files, loc, symbol_count, wave, depends_on, unlocks, external_packages, effect_roots, has_unknown_edges).

    files(path, loc, symbol_count, effect_roots, external_packages), file_edges(from, to, has_unknown).
    """
    spark = files.sparkSession
    files, file_edges = shared_table(files, "plan-files"), shared_table(file_edges, "plan-edges")
    group_of = shared_table(initial_groups(files, file_edges), "plan-groups")
    if coalesce:
        rows = group_of.join(files.select("path", "loc"), "path").select("path", "group", "is_cycle", "loc").collect()  # one row per file
        deps = file_edges.select("from", "to").distinct().collect()
        to = coalesce_small([tuple(r) for r in rows], [tuple(r) for r in deps], max_group_loc)
        merged = spark.createDataFrame(sorted(to.items()), "path string, group string") if to else group_of.select("path", "group")
        group_of = shared_table(group_of.select("path", "is_cycle").join(merged, "path"), "plan-groups")
    links = shared_table(group_links(file_edges, group_of), "plan-links")
    waves = condensation(group_of.select(F.col("group").alias("id")), links).select("id", F.col("level").alias("wave"))  # the groups have no cycles left
    # numbered by (wave, smallest path); a group's name is its smallest path; one row per group
    numbered = shared_table(waves.withColumn("number", F.row_number().over(W.orderBy("wave", "id")) - 1).withColumnRenamed("id", "group"), "plan-numbers")
    near = lambda a, b: links.join(numbered.select(F.col("group").alias(b), F.col("number").alias("n")), b).groupBy(F.col(a).alias("group")).agg(F.sort_array(F.collect_set("n")).alias("ns"))
    ids = lambda c: F.transform(F.coalesce(c, F.array().cast("array<int>")), lambda n: F.concat(F.lit("group:"), n.cast("string")))
    unsure = file_edges.filter("has_unknown")
    unsure = unsure.select(F.col("from").alias("path")).union(unsure.select("to")).distinct().withColumn("unsure", F.lit(True))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    rolled = group_of.join(files, "path").join(unsure, "path", "left").groupBy("group").agg(
        F.array_sort(F.collect_list("path")).alias("files"), F.sum("loc").alias("loc"), F.sum("symbol_count").alias("symbol_count"),
        union("external_packages"), union("effect_roots"), F.coalesce(F.bool_or("unsure"), F.lit(False)).alias("has_unknown_edges"), F.bool_or("is_cycle").alias("is_cycle"),
    )
    out = rolled.join(numbered, "group").join(near("caller", "callee").withColumnRenamed("ns", "d"), "group", "left").join(near("callee", "caller").withColumnRenamed("ns", "u"), "group", "left")
    reason = F.when(F.col("is_cycle"), "cycle").when(F.size("files") > 1, "coalesced-small").otherwise("singleton")
    return out.select(
        F.concat(F.lit("group:"), F.col("number").cast("string")).alias("id"), "number", reason.alias("reason"), "files", "loc", "symbol_count", "wave",
        ids(F.col("d")).alias("depends_on"), ids(F.col("u")).alias("unlocks"), "external_packages", "effect_roots", "has_unknown_edges",
    )


def plan_waves(groups: DataFrame) -> DataFrame:
    """(wave, group_ids, files, loc, group_count)."""
    return groups.groupBy("wave").agg(
        F.transform(F.sort_array(F.collect_list("number")), lambda n: F.concat(F.lit("group:"), n.cast("string"))).alias("group_ids"),
        F.array_sort(F.flatten(F.collect_list("files"))).alias("files"), F.sum("loc").alias("loc"), F.count("*").alias("group_count"),
    )


def plan_stats(groups: DataFrame) -> DataFrame:
    reason = lambda r: F.count_if(F.col("reason") == r)
    return groups.agg(
        F.count("*").alias("groups"), F.coalesce(F.max("wave") + 1, F.lit(0)).alias("waves"), F.coalesce(F.max("loc"), F.lit(0)).alias("largest_group_loc"),
        reason("cycle").alias("cycle_groups"), reason("coalesced-small").alias("coalesced_groups"), reason("singleton").alias("singleton_groups"), F.coalesce(F.sum("loc"), F.lit(0)).alias("total_loc"),
    )
