"""Identifier and path normalisation across languages; built-in expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NamingRules:
    source_src_prefix: str = "src"
    target_src_prefix: tuple[str, ...] = ()
    strip_suffixes: tuple[str, ...] = (".lazy",)
    keep_screaming_consts: bool = True
    keep_pascal_types: bool = True


def kebab_to_snake(s: Column) -> Column:
    return F.replace(s, F.lit("-"), F.lit("_"))


def camel_to_snake(s: Column) -> Column:
    one = F.regexp_replace(s, "(?<=[a-z0-9])(?=[A-Z])", "_")
    return F.lower(F.regexp_replace(one, "(?<=[A-Z])(?=[A-Z][a-z])", "_"))


def is_screaming(s: Column) -> Column:
    return s.rlike("^[A-Z0-9]+(_[A-Z0-9]+)*$") & s.rlike("[A-Z]")


def is_pascal(s: Column) -> Column:
    return s.rlike("^[A-Z]") & s.rlike("[a-z]")


def norm_leaf(leaf: Column, rules: NamingRules = NamingRules()) -> Column:
    keep = F.lit(False)
    if rules.keep_screaming_consts:
        keep |= is_screaming(leaf)
    if rules.keep_pascal_types:
        keep |= is_pascal(leaf)
    return F.when(keep, leaf).otherwise(camel_to_snake(leaf))


def _literal(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "_/" else c for c in s)


def source_module(file: Column, rules: NamingRules = NamingRules()) -> Column:
    base = F.regexp_replace(file, f"^{_literal(rules.source_src_prefix)}/", "")
    base = F.regexp_replace(base, "\\.tsx?$", "")
    for suffix in rules.strip_suffixes:
        base = F.regexp_replace(base, _literal(suffix) + "$", "")
    return kebab_to_snake(base)


def target_module(file: Column, rules: NamingRules = NamingRules()) -> Column:
    cut = F.lit(None).cast("string")
    for p in rules.target_src_prefix:
        cut = F.coalesce(cut, F.when(F.startswith(file, F.lit(p + "/")), F.substring(file, len(p) + 2, 1 << 20)))
    generic = F.when(file.rlike("^crates/[^/]*/src/"), F.regexp_replace(file, "^crates/[^/]*/src/", ""))
    return F.regexp_replace(F.regexp_replace(F.coalesce(cut, generic, file), "\\.rs$", ""), "/mod$", "")


def in_primary(file: Column, rules: NamingRules = NamingRules()) -> Column:
    return F.startswith(file, F.lit(rules.target_src_prefix[0] + "/")) if rules.target_src_prefix else F.lit(True)


def source_leaf(symbol: Column) -> Column:
    """Text after the first '#'; null without one."""
    return F.when(F.contains(symbol, F.lit("#")), F.regexp_replace(symbol, "^[^#]*#", ""))


def source_matchable(leaf: Column) -> Column:
    return F.coalesce((leaf != "") & ~leaf.rlike("[()]|@[0-9]"), F.lit(False))


def source_match_name(leaf: Column, rules: NamingRules = NamingRules()) -> Column:
    return norm_leaf(F.substring_index(leaf, ".", -1), rules)


def target_leaf(symbol: Column) -> Column:
    """Last path segment (of a trait impl: after the last '>::'); null for synthetic ones."""
    work = F.when(F.startswith(symbol, F.lit("<")), F.when(F.contains(symbol, F.lit(">::")), F.substring_index(symbol, ">::", -1))).otherwise(symbol)
    leaf = F.substring_index(work, "::", -1)
    return F.when((leaf != "") & ~leaf.isin("FIELDS", "_") & ~leaf.rlike("^\\{(closure|constant)#[0-9]+\\}$"), leaf)


def ancestors(path: Column) -> Column:
    """All directory prefixes of a path, itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def crate_of(file: Column) -> Column:
    return F.regexp_extract(file, "^crates/([^/]*)", 1)
