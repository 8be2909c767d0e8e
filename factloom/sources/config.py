"""Configuration files: policy, root rules, port packages, libraries, and which extractor a project needs."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.naming import NamingRules
from factloom.operators.policy import Policy
from factloom.schemas import REAL_EFFECTS

#: Root rules by language, from the public documentation of each standard library and of common packages.
BASE_RULES: dict[str, dict[str, str]] = {
    "rust": {
        "std::fs": "fs", "std::net": "net", "std::process": "process", "std::env": "env", "std::time::SystemTime::now": "clock", "std::time::Instant::now": "clock", "std::io::stdin": "fs", "std::io::stdout": "fs", "std::io::stderr": "fs",
        "Box::new": "alloc", "Vec::push": "alloc", "Vec::with_capacity": "alloc", "String::from": "alloc", "tokio::fs": "fs", "tokio::net": "net", "tokio::process": "process", "reqwest": "net", "hyper": "net", "rusqlite": "db", "sqlx": "db", "diesel": "db", "rand": "random", "getrandom": "random", "chrono::Utc::now": "clock", "chrono::Local::now": "clock",
    },
    "typescript": {
        "node:fs": "fs", "fs": "fs", "node:net": "net", "net": "net", "node:http": "net", "http": "net", "https": "net", "global::fetch": "net", "node:child_process": "process", "child_process": "process", "global::process": "env", "node:os": "env", "os": "env", "global::Date::now": "clock", "global::performance": "clock", "global::Math::random": "random", "node:crypto::randomBytes": "random",
        "axios": "net", "pg": "db", "mysql2": "db", "better-sqlite3": "db", "mongodb": "db", "ioredis": "db", "execa": "process", "fs-extra": "fs",
    },
    "python": {
        "builtins::open": "fs", "os::path": "fs", "pathlib::Path": "fs", "shutil": "fs", "tempfile": "fs", "socket": "net", "urllib::request": "net", "http::client": "net", "subprocess": "process", "os::system": "process", "os::environ": "env", "os::getenv": "env", "time::time": "clock", "datetime::datetime::now": "clock", "random": "random", "secrets": "random", "uuid::uuid4": "random", "sqlite3": "db",
        "requests": "net", "httpx": "net", "aiohttp": "net", "sqlalchemy": "db", "psycopg": "db", "boto3": "net",
    },
    "go": {"os::Open": "fs", "os::Create": "fs", "os::ReadFile": "fs", "os::WriteFile": "fs", "net": "net", "net/http": "net", "os/exec": "process", "os::Getenv": "env", "time::Now": "clock", "math/rand": "random", "crypto/rand": "random", "database/sql": "db"},
}


def load_policy(path: str | Path) -> tuple[Policy, dict[str, str], tuple[str, ...]]:
    """(policy, root rules, pure prefixes) of a TOML file."""
    doc = tomllib.loads(Path(path).read_text())
    analysis, rules = doc.get("analysis", {}), doc.get("rules", {})
    mode = analysis.get("on_unknown", "fail")
    if mode not in ("fail", "warn", "ignore"):
        raise ValueError(f"on_unknown is '{mode}'")
    policy = Policy(regions=doc.get("region", {}), ignore=tuple(analysis.get("ignore", ())), on_unknown=mode, enabled=tuple(rules.get("enable", ())), rule_config={k: v for k, v in rules.items() if isinstance(v, dict)})
    for name in policy.regions:
        policy.forbidden(name)
    seeds, pure = read_rules(doc)
    return policy, seeds, pure


def read_rules(doc: Mapping[str, Any]) -> tuple[dict[str, str], tuple[str, ...]]:
    """(prefix -> effect, pure prefixes) of the tables [roots] and [trust]."""
    seeds, pure = dict(doc.get("roots", {})), []
    for prefix, what in doc.get("trust", {}).items():
        if what == "pure":
            pure.append(prefix)
        else:
            for effect in what:
                seeds[prefix] = effect
    for prefix, effect in seeds.items():
        if effect not in REAL_EFFECTS:
            raise ValueError(f"'{prefix}': '{effect}' can't be assigned")
    return seeds, tuple(pure)


def merged_rules(language: str, *files: str | Path) -> tuple[dict[str, str], tuple[str, ...]]:
    """Rules of a language, retargeted in their place by each later file, which adds its new ones at the end; languages never mix."""
    seeds, pure = dict(BASE_RULES.get(language, {})), ()
    for f in files:
        more, trusted = read_rules(tomllib.loads(Path(f).read_text()))
        for k, v in more.items():
            seeds[k] = v
        pure += trusted
    return seeds, pure


def language_of(definitions: DataFrame) -> str:
    """Language of a fact base: the first definition (by id) that isn't Rust decides, else Rust."""
    found = definitions.filter("language <> 'rust'").agg(F.min_by("language", "id")).first()[0]
    return found or "rust"


@dataclass(frozen=True)
class PortPackage:
    name: str
    source: str
    targets: tuple[str, ...]
    naming: NamingRules = field(default_factory=NamingRules)


def load_port_packages(path: str | Path) -> list[PortPackage]:
    """Packages of a port: one shared [naming] block and a table per package, with `target` or `targets`, not both."""
    doc, out = tomllib.loads(Path(path).read_text()), []
    shared = doc.get("naming", {})
    for p in doc.get("package", []):
        if ("target" in p) == ("targets" in p):
            raise ValueError(f"package '{p.get('name')}': give either target or targets")
        targets = tuple(p["targets"]) if "targets" in p else (p["target"],)
        rules = {k: v for k, v in {**shared, **p.get("naming", {})}.items() if k in NamingRules.__dataclass_fields__}
        rules = {k: tuple(v) if isinstance(v, list) else v for k, v in rules.items()}
        rules["target_src_prefix"] = tuple(f"{t.rstrip('/')}/src" for t in targets)
        out.append(PortPackage(p["name"], p["source"], targets, NamingRules(**rules)))
    return out


LIBRARY_SOURCES = ("curated", "rustdoc")
LIBRARY_KINDS = ("derive", "trait", "function")


def load_libraries(path: str | Path) -> tuple[list[dict[str, Any]], list[str]]:
    """(entries, notes): entries of unknown source or kind are left out with a note."""
    entries, notes = [], []
    for e in tomllib.loads(Path(path).read_text()).get("library", []):
        if e.get("source") not in LIBRARY_SOURCES:
            notes.append(f"{e.get('name')}: unknown source '{e.get('source')}'")
        elif e.get("kind", "function") not in LIBRARY_KINDS:
            notes.append(f"{e.get('name')}: unknown kind '{e.get('kind')}'")
        else:
            entries.append({"name": e["name"], "source": e["source"], "kind": e.get("kind", "function"), "items": list(e.get("items", [])), "trust": float(e.get("trust", 0.8))})
    return entries, notes


MARKERS = (("Cargo.toml", "rust"), ("tsconfig.json", "typescript"), ("pyproject.toml", "python"), ("go.mod", "go"))


def project_language(folder: str | Path) -> str | None:
    """By the marker file in a folder, the first of the list that is there."""
    return next((language for name, language in MARKERS if (Path(folder) / name).exists()), None)


def union_root(*paths: str | Path) -> Path:
    """The nearest folder at or above the common ancestor that is a recognised project; the ancestor if none is."""
    parts = [Path(p).resolve().parts for p in paths]
    common = Path(*[x[0] for x in zip(*parts) if len(set(x)) == 1])
    return next((p for p in (common, *common.parents) if project_language(p)), common)


def package_of_path(path: Column, patterns: list[tuple[str, str]]) -> Column:
    """First template whose pattern matches, with its capture groups {1}, {2}, ... filled; null without a match."""
    out = F.lit(None).cast("string")
    for pattern, template in patterns:
        pieces = [F.regexp_extract(path, pattern, int(p)) if i % 2 else F.lit(p) for i, p in enumerate(re.split(r"\{(\d)\}", template))]
        out = F.coalesce(out, F.when(path.rlike(pattern), F.concat(*pieces)))
    return out


def provenance_effects(symbols: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, effect) for symbols(id, package): the longest rule(prefix, effect) among 'package::name' and its ancestors."""
    whole = F.concat_ws("::", "package", F.substring_index("id", "::", -1))
    parts = F.split(whole, "::|/|\\.")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "::"))
    met = symbols.select("id", F.posexplode(heads).alias("depth", "prefix")).join(F.broadcast(rules), "prefix")  # rules are configuration
    return met.groupBy("id").agg(F.max_by("effect", "depth").alias("effect"))
