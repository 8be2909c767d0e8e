"""Column functions over symbol paths (`crate::module::leaf`), globs and rounding; all built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def package_of(symbol: Column) -> Column:
    return F.substring_index(symbol, "::", 1)


def leaf_name(symbol: Column) -> Column:
    return F.substring_index(symbol, "::", -1)


def strip_generics(symbol: Column) -> Column:
    """The path without balanced <...> groups; runs of colons become one separator."""
    inner = "<[^<>]*>"
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(symbol, inner, ""), inner, ""), inner, "")
    out = F.when(out.contains("<"), _outside(out)).otherwise(out)  # the scan is for what three passes leave
    return F.regexp_replace(out, ":{2,}", "::")


def _outside(symbol: Column) -> Column:
    """What is outside <...>, of any nesting; an open group reaches to the end."""
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("depth"))

    def step(a: Column, c: Column) -> Column:
        depth = a["depth"] + F.when(c == "<", 1).when((c == ">") & (a["depth"] > 0), -1).otherwise(0)
        keep = (a["depth"] == 0) & (c != "<")
        return F.struct(F.when(keep, F.concat(a["kept"], c)).otherwise(a["kept"]).alias("kept"), depth.alias("depth"))

    return F.aggregate(F.split(symbol, ""), start, step, lambda a: a["kept"])


def path_segments(symbol: Column) -> Column:
    return F.filter(F.split(symbol, "::"), lambda s: s != "")


def segment_runs(symbol: Column) -> Column:
    """All contiguous runs of a path's segments, each joined by '::' (distinct)."""
    segments = path_segments(symbol)
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(segments), F.lit(1))),
        lambda i: F.transform(F.sequence(i, F.greatest(F.size(segments), i)), lambda j: F.array_join(F.slice(segments, i, j - i + 1), "::")),
    )
    return F.array_distinct(F.when(F.size(segments) > 0, F.flatten(runs)).otherwise(F.array().cast("array<string>")))


def leading_crate(symbol: Column) -> Column:
    """First identifier that a colon follows; null without one."""
    found = F.regexp_extract(symbol, "([A-Za-z0-9_]+):", 1)
    return F.when(found != "", found)


_TRUSTED = "(?:std|core|alloc)::"


def trusted_pure(symbol: Column) -> Column:
    """Covered by the trusted baseline: own path, trait or receiver in the standard library."""
    own = F.regexp_replace(strip_generics(symbol), "^:+", "").rlike("^" + _TRUSTED)
    return own | symbol.rlike(" as " + _TRUSTED) | symbol.rlike(r"^<[&*\s]*(?:dyn )*(?:mut )*\s*" + _TRUSTED)


def glob_to_regex(glob: str) -> str:
    """Anchored regular expression of a glob; '*' crosses '/', as '**' does."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i:] == "/**":
            out, i = out + "/.*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + ".*", i + 1
        elif glob[i] == "?":
            out, i = out + ".", i + 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def round_half_away(x: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.round(x * scale) / scale
