"""How far a port has come: tiered symbol matching between two graphs, bands per file, frontier, merges and deltas."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions.naming import NamingRules, ancestors, crate_of, in_primary, source_leaf, source_matchable, source_match_name, source_module, target_leaf, target_module
from factloom.functions.symbols import round_half_away

TIERS = ("exact-module", "subtree", "global-name", "unmatched")
BANDS = ("NOT-STARTED", "STARTED", "RELOCATED", "PORTED", "DONE")
PORTED_THRESHOLD = 0.6
RETAIN = 0.5
FRONTIER = 25


def source_symbols(symbols: DataFrame, rules: NamingRules = NamingRules()) -> DataFrame:
    """(id, file, module, leaf) of the matchable symbols under the source prefix."""
    own = symbols.filter(~F.coalesce(F.col("external"), F.lit(False)) & F.startswith("file", F.lit(rules.source_src_prefix + "/"))).withColumn("raw", source_leaf(F.col("id")))
    return own.filter(source_matchable(F.col("raw"))).select("id", "file", source_module(F.col("file"), rules).alias("module"), source_match_name(F.col("raw"), rules).alias("leaf"))


def target_symbols(symbols: DataFrame, rules: NamingRules = NamingRules()) -> DataFrame:
    """(id, file, module, leaf, is_impl, primary)."""
    own = symbols.filter(~F.coalesce(F.col("external"), F.lit(False)) & F.startswith("file", F.lit("crates/"))).withColumn("leaf", target_leaf(F.col("id")))
    return own.filter("leaf IS NOT NULL").select("id", "file", target_module(F.col("file"), rules).alias("module"), "leaf", F.startswith("id", F.lit("<")).alias("is_impl"), in_primary(F.col("file"), rules).alias("primary"))


def _representatives(targets: DataFrame, *key: str) -> DataFrame:
    """Per key the target that stands for it: no trait impl if possible, then the shortest id, then the smallest."""
    return targets.groupBy(*key).agg(F.min_by("id", F.struct("is_impl", F.octet_length("id"), "id")).alias("rep"))


def map_files(files: DataFrame, sources: DataFrame, targets: DataFrame, retain: float = RETAIN, rules: NamingRules = NamingRules()) -> DataFrame:
    """(file, module, subtree, method, votes) for files(file).

    'exact': the target has the module; 'exact-subtree': as a directory; 'graph-cluster': the deepest target prefix that
    keeps `retain` of the votes of the file's leaves, each of which splits one vote among the modules it is found in.
    """
    own = files.select("file", source_module(F.col("file"), rules).alias("module"))
    modules = targets.select("module").distinct()
    below = modules.select("module", F.explode(ancestors(F.col("module"))).alias("prefix"))
    exact = modules.withColumn("exact", F.lit(True))
    tree = below.select(F.col("prefix").alias("module")).distinct().withColumn("tree", F.lit(True))
    breadth = below.groupBy("prefix").agg(F.count("*").alias("breadth"))
    places = targets.select("leaf", "module").distinct()
    share = places.join(places.groupBy("leaf").agg((F.lit(1.0) / F.count("*")).alias("w")), "leaf")
    votes = sources.select("file", "leaf").distinct().join(share, "leaf").select("file", "module", "w")
    mass = votes.join(below, "module").groupBy("file", "prefix").agg(F.round(F.sum("w"), 9).alias("v")).join(breadth, "prefix").withColumn("depth", F.size(F.split("prefix", "/")))
    top = mass.withColumn("most", F.max("v").over(W.partitionBy("file"))).filter(F.col("v") >= retain * F.col("most"))
    best = top.groupBy("file").agg(F.min_by(F.struct("prefix", "v"), F.struct(-F.col("depth"), -F.col("v"), "breadth", "prefix")).alias("best"))
    met = own.join(exact, "module", "left").join(tree, "module", "left").join(best, "file", "left")
    near = F.when(F.col("best.v") >= 0.5, F.col("best"))
    plain = F.col("exact").isNull() & F.col("tree").isNull()
    return met.select(
        "file", "module", F.when(plain, near["prefix"]).otherwise(F.col("module")).alias("subtree"),
        F.when(F.col("exact"), "exact").when(F.col("tree"), "exact-subtree").when(near.isNotNull(), "graph-cluster").alias("method"),
        F.when(plain, round_half_away(near["v"], 2)).alias("votes"),
    )


def match_symbols(sources: DataFrame, targets: DataFrame, file_map: DataFrame) -> DataFrame:
    """sources with (tier, target): same module; under the file's subtree; same basename; same leaf anywhere."""
    one = _representatives(targets, "module", "leaf").withColumnRenamed("rep", "t1")
    two = _representatives(targets.withColumn("subtree", F.explode(ancestors(F.col("module")))), "subtree", "leaf").withColumnRenamed("rep", "t2")
    three = _representatives(targets.withColumn("base", F.substring_index("module", "/", -1)), "base", "leaf").withColumnRenamed("rep", "t3")
    four = _representatives(targets, "leaf").withColumnRenamed("rep", "t4")
    met = sources.join(file_map.select("file", "subtree"), "file", "left").withColumn("base", F.substring_index("module", "/", -1))
    met = met.join(one, ["module", "leaf"], "left").join(two, ["subtree", "leaf"], "left").join(three, ["base", "leaf"], "left").join(four, "leaf", "left")
    tier = F.when(F.col("t1").isNotNull(), TIERS[0]).when(F.col("t2").isNotNull(), TIERS[1]).when(F.col("t4").isNotNull(), TIERS[2]).otherwise(TIERS[3])
    return met.select("id", "file", "module", "leaf", tier.alias("tier"), F.coalesce("t1", "t2", "t3", "t4").alias("target"))


def confirm_by_graph(matched: DataFrame, source_calls: DataFrame, target_calls: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, overlap, confirmed) of matched symbols with matched callees: the share of callee names that the target calls too."""
    real = matched.filter("target IS NOT NULL")
    calls = source_calls.select("caller", "callee").distinct()
    names = calls.join(real.select(F.col("id").alias("callee"), F.col("leaf").alias("name")), "callee")
    asked = real.select("id", "target").join(names, F.col("id") == F.col("caller")).select("id", "target", "name")
    has = target_calls.join(targets.select(F.col("id").alias("callee"), "leaf"), "callee").select(F.col("caller").alias("target"), F.col("leaf").alias("name"), F.lit(1).alias("hit")).distinct()
    out = asked.join(has, ["target", "name"], "left").groupBy("id").agg((F.count("hit") / F.count("*")).alias("overlap"))
    return out.withColumn("confirmed", F.col("overlap") >= 0.5)


def classify_band(native: Column, total: Column, coverage: Column, started: Column, threshold: float) -> Column:
    ported = (total > 0) & F.coalesce(coverage >= threshold, F.lit(False))
    return F.when(native, "DONE").when(ported, "PORTED").when(started, "STARTED").otherwise("NOT-STARTED")


def band_rank(band: Column) -> Column:
    return F.array_position(F.array(*[F.lit(b) for b in BANDS]), band) - 1


def contributions(matched: DataFrame, targets: DataFrame) -> DataFrame:
    """(file, target_file, strong_matched, total_matched): how many of a file's symbols landed in a target file."""
    at = targets.select(F.col("id").alias("target"), F.col("file").alias("target_file"))
    return matched.join(at, "target").groupBy("file", "target_file").agg(F.count_if(F.col("tier").isin(*TIERS[:2])).alias("strong_matched"), F.count("*").alias("total_matched"))


def file_bands(files: DataFrame, matched: DataFrame, targets: DataFrame, file_map: DataFrame, confirmed: DataFrame | None = None, native: DataFrame | None = None, threshold: float = PORTED_THRESHOLD) -> DataFrame:
    """One row per file of files(file): counts by tier, coverage, band and dominant target file."""
    per = matched.groupBy("file").agg(
        F.count("*").alias("total"), F.count("target").alias("matched"), *[F.count_if(F.col("tier") == t).alias("n_" + t.replace("-", "_")) for t in TIERS],
    )
    landed = matched.join(targets.select(F.col("id").alias("target"), "primary"), "target").groupBy("file").agg(F.count("*").alias("resolved"), F.count_if(~F.col("primary")).alias("secondary"))
    top = contributions(matched, targets).groupBy("file").agg(F.min_by(F.struct("target_file", "total_matched"), F.struct(-F.col("total_matched"), "target_file")).alias("top"))
    out = files.select("file").join(file_map.select("file", "subtree", "method"), "file", "left").join(per, "file", "left").join(landed, "file", "left").join(top, "file", "left")
    if native is not None:
        out = out.join(native.select("file").distinct().withColumn("native", F.lit(True)), "file", "left")
    else:
        out = out.withColumn("native", F.lit(False))
    if confirmed is not None:
        per_confirm = matched.join(confirmed, "id").groupBy("file").agg(F.count("*").alias("ev"), F.count_if("confirmed").alias("ok"))
        out = out.join(per_confirm, "file", "left").withColumn("confirmed_coverage", round_half_away(F.try_divide("ok", "ev"), 3))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    coverage = F.try_divide(zero("matched"), F.col("total"))
    band = classify_band(F.coalesce("native", F.lit(False)), zero("total"), coverage, (zero("matched") >= 1) | F.col("subtree").isNotNull(), threshold)
    moved = band.isin("PORTED", "STARTED") & (zero("resolved") > 0) & (zero("secondary") * 2 > zero("resolved"))
    extra = [F.col("confirmed_coverage")] if confirmed is not None else []
    return out.select(
        F.col("file").alias("path"), F.when(moved, "RELOCATED").otherwise(band).alias("band"), round_half_away(coverage, 3).alias("coverage"), zero("total").alias("total_symbols"), zero("matched").alias("matched_symbols"),
        *[zero("n_" + t.replace("-", "_")).alias(t.replace("-", "_")) for t in TIERS], F.col("subtree").alias("mapped_target"), "method", F.col("top.target_file").alias("dominant_target_file"),
        F.coalesce("top.total_matched", F.lit(0)).alias("dominant_target_symbols"), *extra,
    )


def tier_totals(matched: DataFrame) -> DataFrame:
    one = [F.count_if(F.col("tier") == t).alias(t.replace("-", "_")) for t in TIERS]
    return matched.agg(*one, F.count("*").alias("total"), round_half_away(F.try_divide(F.count("target"), F.count("*")), 3).alias("matched_pct"))


def wave_bands(bands: DataFrame, wave_files: DataFrame) -> DataFrame:
    """Bands and symbol totals per wave, from wave_files(wave, path)."""
    per = [F.count_if(F.col("band") == b).alias(b.lower().replace("-", "_")) for b in BANDS]
    out = wave_files.distinct().join(bands, "path").groupBy("wave").agg(F.count("*").alias("files"), *per, F.sum("total_symbols").alias("symbols_total"), F.sum("matched_symbols").alias("symbols_matched"))
    return out.withColumn("symbols_pct", F.coalesce(round_half_away(F.try_divide("symbols_matched", "symbols_total"), 3), F.lit(0.0)))


def ready_frontier(bands: DataFrame, file_edges: DataFrame, fan_in: DataFrame, top: int | None = FRONTIER, rules: NamingRules = NamingRules()) -> DataFrame:
    """Files still to do whose source dependencies are all PORTED or DONE (or unknown): highest fan_in first; top of them."""
    deps = file_edges.filter((F.col("from") != F.col("to")) & F.startswith("to", F.lit(rules.source_src_prefix + "/"))).select("from", "to").distinct()
    state = deps.join(bands.select(F.col("path").alias("to"), "band"), "to", "left").groupBy(F.col("from").alias("path")).agg(F.count("*").alias("dep_count"), F.bool_and(F.coalesce(F.col("band").isin("PORTED", "DONE"), F.lit(True))).alias("ready"))
    out = bands.filter(~F.col("band").isin("PORTED", "DONE")).join(state, "path", "left").filter(F.coalesce("ready", F.lit(True)))
    out = out.join(fan_in.select("path", "fan_in"), "path", "left").select("path", "band", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), "total_symbols", "matched_symbols", "coverage", F.coalesce("dep_count", F.lit(0)).alias("dep_count"), "mapped_target")
    return out if top is None else out.orderBy(F.desc("fan_in"), "path").limit(top)


def substantial(rows: DataFrame) -> DataFrame:
    return rows.filter("strong_matched >= 2 OR (total_matched >= 3 AND strong_matched >= 1) OR total_matched >= 4")


def file_merges(rows: DataFrame) -> DataFrame:
    """Target files with substantial contributions of two or more source files; rows(package, file, target_file, strong_matched, total_matched)."""
    one = substantial(rows).groupBy("target_file", "file").agg(F.min_by(F.struct("package", "strong_matched", "total_matched"), F.struct("package")).alias("c")).select("target_file", "file", "c.*")
    out = one.groupBy("target_file").agg(
        F.count("*").alias("contributors"), F.sum("strong_matched").alias("strong"), F.array_sort(F.collect_set("package")).alias("packages"),
        F.array_sort(F.collect_list(F.struct((-F.col("strong_matched")).alias("s"), (-F.col("total_matched")).alias("t"), "file"))).alias("order"),
    )
    return out.filter("contributors >= 2").select(
        "target_file", "contributors", "strong", "packages", F.transform("order", lambda c: c["file"]).alias("source_files"), (F.size(F.filter("packages", lambda p: p != "")) >= 2).alias("cross_package"),
    )


def misplacements(rows: DataFrame, owners: Mapping[str, str] | None = None) -> DataFrame:
    """Substantial contributions into a crate that another package owns (given, else by plurality, ties to the smaller name)."""
    real = substantial(rows).withColumn("target_crate", crate_of(F.col("target_file"))).filter("package <> '' AND target_crate <> ''")
    counts = real.groupBy("target_crate", "package").agg(F.count("*").alias("n"))
    owning = counts.groupBy("target_crate").agg(F.min_by("package", F.struct(-F.col("n"), "package")).alias("owning_package"))
    if owners:
        given = F.create_map(*[F.lit(x) for kv in sorted(owners.items()) for x in kv])
        owning = owning.withColumn("owning_package", F.coalesce(F.element_at(given, F.col("target_crate")), "owning_package"))
    return real.join(owning, "target_crate").filter("owning_package <> package").select("file", F.col("package").alias("source_package"), "target_file", "target_crate", "owning_package", "strong_matched", "total_matched")


def report_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per (package, path): bands and coverage before and after, with the direction."""
    key = ["package", "path"]
    b = before.select(*key, F.col("band").alias("band_before"), F.col("coverage").alias("coverage_before"), F.lit(True).alias("was"))
    a = after.select(*key, F.col("band").alias("band_after"), F.col("coverage").alias("coverage_after"), F.lit(True).alias("now"))
    up = band_rank(F.col("band_after")) - band_rank(F.col("band_before"))
    direction = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(up > 0, "advanced").when(up < 0, "regressed").otherwise("unchanged")
    return b.join(a, key, "full_outer").select(*key, "band_before", "band_after", direction.alias("direction"), "coverage_before", "coverage_after", round_half_away(F.col("coverage_after") - F.col("coverage_before"), 3).alias("coverage_delta"))


DIRECTIONS = ("advanced", "regressed", "unchanged", "added", "removed")


def delta_totals(delta: DataFrame) -> DataFrame:
    """One row: files by direction, net movement of each band, verdict."""
    net = [(F.count_if(F.col("band_after") == b) - F.count_if(F.col("band_before") == b)).alias("net_" + b.lower().replace("-", "_")) for b in BANDS]
    out = delta.agg(*[F.count_if(F.col("direction") == d).alias(d) for d in DIRECTIONS], *net)
    verdict = F.when((F.col("advanced") > 0) & (F.col("regressed") > 0), "mixed").when(F.col("advanced") > 0, "forward").when(F.col("regressed") > 0, "backward").otherwise("no-change")
    return out.withColumn("verdict", verdict)


def delta_transitions(delta: DataFrame) -> DataFrame:
    return delta.filter("direction IN ('advanced', 'regressed')").groupBy("band_before", "band_after").agg(F.count("*").alias("count"))


def package_totals(bands: DataFrame) -> DataFrame:
    """Per package files by band, symbols, and the share matched (of sums, not a mean of shares)."""
    per = [F.count_if(F.col("band") == b).alias(b.lower().replace("-", "_")) for b in BANDS]
    out = bands.groupBy("package").agg(F.count("*").alias("files"), *per, F.sum("total_symbols").alias("symbols_total"), F.sum("matched_symbols").alias("symbols_matched"))
    return out.withColumn("symbols_pct", F.coalesce(round_half_away(F.try_divide("symbols_matched", "symbols_total"), 3), F.lit(0.0)))


def delta_line(totals: DataFrame, transitions: DataFrame) -> str:
    """One line for people: verdict, counts, and every transition (regressions included)."""
    t = totals.first()
    moves = ", ".join(f"{r['count']} {r['band_before']} -> {r['band_after']}" for r in transitions.orderBy(band_rank(F.col("band_before")), band_rank(F.col("band_after"))).collect())
    return f"{t['verdict']}: {t['advanced']} advanced, {t['regressed']} regressed, {t['added']} added, {t['removed']} removed" + (f" ({moves})" if moves else "")
