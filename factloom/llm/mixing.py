"""Mixing sources to target weights by hierarchical budgeting.

The corpus is a tree: domain -> language -> source.  A token budget enters at the root and is split among the children
of each node by weight.  A child can't take more than its capacity (tokens of its leaves times the allowed epochs);
what it can't take is shared by its siblings in proportion to their weights, and leaves the parent only when all
siblings are full - which shows one level up as the parent's own capacity.  That is water-filling at each node, and it
has a closed form: order children by capacity/weight; child k is full exactly if its ratio is at most the level
(budget left after the full ones) / (weight of the others).  So the whole allocation is three window queries over the
aggregated tree (one row per leaf) and no loop.

Each leaf then takes its quota as a prefix of a seeded, endless sequence of epochs: epoch e holds every document of
the leaf in the order of md5(seed:e:doc_id).  Whole epochs that fit are taken whole; of the next one, the documents
whose running token total stays within the rest.  The running total is two-level (hash-range buckets of bounded size,
then inside the bucket that the quota ends in), so a hot leaf is never sorted in one task.

Defined cases: null domain, language or source make their own branch 'unknown'; null, empty and blank texts have no
tokens, cost nothing, and are not selected; a weight that isn't given is 1, a weight of 0 or less closes its branch;
repeated rows are separate documents of the leaf with equal place in the order, kept or dropped together; an empty table
gives an empty result; a budget beyond all capacities selects everything; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.llm.common import WHITE, WORD_COUNT_SQL, partitions_for, small_side, word_count
from factloom.storage import shared_table

SEED = "mix-1"
#: Share of the corpus' tokens that the mixture may hold.
BUDGET = 0.6
MAX_EPOCHS = 2
BUCKET_TOKENS = 8_000_000
DOMAIN_WEIGHTS = {"web": 5, "books": 3, "code": 2, "forum": 4}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 1}
SOURCE_WEIGHTS = {"src0": 2}


def default_domain(source: Column) -> Column:
    """Domains of the numbered test sources; a deployment passes its own expression."""
    number = F.coalesce(F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)$", 1).try_cast("int"), F.lit(0))
    return F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("code"), F.lit("forum")), number % 4 + 1)


def _weight(name: Column, weights: Mapping[str, int]) -> Column:
    if not weights:
        return F.lit(1.0)
    pairs = [x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.element_at(F.create_map(*pairs), name), F.lit(1.0))


def _split(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Water-filling of `budget` (same in all rows of a parent) over rows with `cap` and `w`; adds `quota`."""
    near = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(1))
    by = near.orderBy("ratio", name)
    full = nodes.filter("w > 0 AND cap > 0").withColumn("ratio", F.col("cap") / F.col("w"))
    full = full.withColumn("before", F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    full = full.withColumn("rest", F.sum("w").over(by.rowsBetween(W.currentRow, W.unboundedFollowing)))
    full = full.withColumn("is_full", F.col("ratio") * F.col("rest") <= F.col("budget") - F.col("before"))
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("is_full"), F.col("cap"))).over(near), F.lit(0.0))
    open_w = F.sum(F.when(~F.col("is_full"), F.col("w"))).over(near)
    full = full.withColumn("left", left).withColumn("open_w", open_w)
    return full.withColumn("quota", F.when(F.col("is_full"), F.col("cap")).otherwise(F.col("left") * F.col("w") / F.col("open_w")))


def allocate(leaves: DataFrame, budget: float, max_epochs: int, domain_weights: Mapping[str, int], lang_weights: Mapping[str, int], source_weights: Mapping[str, int]) -> DataFrame:
    """leaves(domain, lang, source, tokens) -> the same with quota (whole tokens). `budget` is a share of all tokens."""
    base = leaves.withColumn("cap", F.col("tokens").cast("double") * max_epochs).withColumn("w", _weight(F.col("source"), source_weights)).filter("w > 0")
    langs = base.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("w", _weight(F.col("lang"), lang_weights)).filter("w > 0")
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("w", _weight(F.col("domain"), domain_weights))
    total = leaves.agg((F.sum("tokens") * F.lit(budget)).alias("budget"))
    top = _split(domains.crossJoin(F.broadcast(total)), [], "domain").select("domain", F.col("quota").alias("budget"))  # one row
    mid = _split(langs.join(top, "domain"), ["domain"], "lang").select("domain", "lang", F.col("quota").alias("budget"))
    low = _split(base.join(mid, ["domain", "lang"]), ["domain", "lang"], "source")
    return low.select("domain", "lang", "source", "tokens", F.floor(F.col("quota") + F.lit(1e-3)).cast("long").alias("quota"))


def mix(
    docs: DataFrame,
    budget: float = BUDGET,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    domain_weights: Mapping[str, int] = DOMAIN_WEIGHTS,
    lang_weights: Mapping[str, int] = LANG_WEIGHTS,
    source_weights: Mapping[str, int] = SOURCE_WEIGHTS,
    bucket_tokens: int = BUCKET_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
    domain: Callable[[Column], Column] = default_domain,
    tokens: Column | None = None,
) -> DataFrame:
    """One row per chosen document and epoch: (doc_id, domain, lang, source, epoch, n_tokens).

    domain: expression of the source column; null is 'unknown'.  tokens: a column of token counts instead of words.
    """
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(domain(F.col("source")), F.lit("unknown")).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("unknown")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("unknown")).alias("source"),
        (word_count(F.col(text_col)) if tokens is None else tokens.cast("long")).alias("n_tokens"),
    ).filter("n_tokens > 0")
    sized = shared_table(sized, "mixing-sizes")  # the text is read once
    leaf = ["domain", "lang", "source"]
    leaves = sized.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"))
    quotas = allocate(leaves, budget, max_epochs, domain_weights, lang_weights, source_weights)
    total = sized.agg(F.sum("n_tokens")).first()[0]
    buckets = partitions_for(total, bucket_tokens)

    plan = quotas.select(*leaf, F.floor(F.col("quota") / F.col("tokens")).cast("int").alias("whole"), F.pmod(F.col("quota"), F.col("tokens")).alias("rest"))
    plan = shared_table(plan.filter("whole > 0 OR rest > 0"), "mixing-plan")  # one row a leaf
    with_plan = sized.join(plan, leaf)
    whole = with_plan.filter("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
    part = with_plan.filter("rest > 0").withColumn("epoch", F.col("whole"))
    part = part.withColumn("place", F.md5(F.concat(F.lit(seed + ":"), F.col("epoch").cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    # The first 28 bits of the order put a document into one of `buckets` ranges of about equal size.
    part = part.withColumn("bucket", (F.conv(F.substring("place", 1, 7), 16, 10).cast("double") * buckets / float(1 << 28)).cast("int"))
    sums = part.groupBy(*leaf, "bucket").agg(F.sum("n_tokens").alias("tokens"), F.first("rest").alias("rest"))
    sums = sums.withColumn("before", F.sum("tokens").over(W.partitionBy(*leaf).orderBy("bucket")) - F.col("tokens"))
    sums = sums.filter("before < rest").select(*leaf, "bucket", "before", (F.col("before") + F.col("tokens") <= F.col("rest")).alias("inside"))
    ranged = part.join(sums, [*leaf, "bucket"])
    edge = ranged.filter("NOT inside").withColumn("upto", F.col("before") + F.sum("n_tokens").over(W.partitionBy(*leaf, "bucket").orderBy("place").rangeBetween(W.unboundedPreceding, W.currentRow)))
    cols = ["doc_id", *leaf, "epoch", "n_tokens"]
    chosen = whole.select(*cols).unionByName(ranged.filter("inside").select(*cols)).unionByName(edge.filter("upto <= rest").select(*cols))
    return chosen


def select_mix(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs, all columns, that mix() chooses, once per epoch."""
    chosen = mix(docs, **parameters).select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "lang", "source", "epoch")]).distinct()
    chosen = small_side(shared_table(chosen, "mixing-chosen"))
    same = docs["doc_id"].cast("long").eqNullSafe(chosen["_doc_id"])
    for c in ("lang", "source"):
        same &= F.coalesce(docs[c].cast("string"), F.lit("unknown")) == chosen[f"_{c}"]
    return docs.filter(F.col("text").rlike(f"[^{WHITE}]")).join(chosen, same).select(*[docs[c] for c in docs.columns])


def _case(col: str, weights: Mapping[str, int]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {float(v)!r}" for k, v in sorted(weights.items())) + " ELSE 1.0 END" if weights else "1.0"


def _split_sql(source: str, parent: str, name: str, out: str) -> str:
    near = f"PARTITION BY {parent}" if parent else ""
    return f"""
  {out}_a AS (SELECT *, cap / w AS ratio, coalesce(sum(cap) OVER ({near} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
      sum(w) OVER ({near} ORDER BY cap / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {source} WHERE w > 0 AND cap > 0),
  {out}_b AS (SELECT *, ratio * rest <= budget - before AS is_full FROM {out}_a),
  {out} AS (SELECT *, CASE WHEN is_full THEN cap ELSE
      (budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({near}), 0.0)) * w / (sum(CASE WHEN NOT is_full THEN w END) OVER ({near})) END AS quota FROM {out}_b)"""


def mixing_ctes(docs: str = "documents", budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> str:
    """CTEs that end in `mixed`, the rows of mix() with the defaults."""
    return f"""
  sized AS (SELECT * FROM (SELECT doc_id, ['web','books','code','forum'][coalesce(try_cast(regexp_extract(coalesce(source,''), '([0-9]+)$', 1) AS INTEGER), 0) % 4 + 1] AS domain,
      coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, {WORD_COUNT_SQL.format("text")} AS n_tokens FROM {docs}) WHERE n_tokens > 0),
  leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM sized GROUP BY ALL),
  base AS (SELECT *, CAST(tokens AS DOUBLE) * {max_epochs} AS cap, {_case("source", SOURCE_WEIGHTS)} AS w FROM leaves WHERE {_case("source", SOURCE_WEIGHTS)} > 0),
  langs AS (SELECT domain, lang, sum(cap) AS cap, {_case("lang", LANG_WEIGHTS)} AS w FROM base GROUP BY domain, lang HAVING {_case("lang", LANG_WEIGHTS)} > 0),
  domains AS (SELECT d.*, (SELECT CAST(sum(tokens) AS DOUBLE) * {budget}::DOUBLE FROM leaves) AS budget FROM (SELECT domain, sum(cap) AS cap, {_case("domain", DOMAIN_WEIGHTS)} AS w FROM langs GROUP BY domain) d),
  {_split_sql("domains", "", "domain", "top")},
  langs2 AS (SELECT l.*, t.quota AS budget FROM langs l JOIN top t USING (domain)),
  {_split_sql("langs2", "domain", "lang", "mid")},
  base2 AS (SELECT b.*, m.quota AS budget FROM base b JOIN mid m USING (domain, lang)),
  {_split_sql("base2", "domain, lang", "source", "low")},
  quotas AS (SELECT domain, lang, source, CAST(floor(quota + 1e-3) AS BIGINT) // CAST(tokens AS BIGINT) AS whole, CAST(floor(quota + 1e-3) AS BIGINT) % CAST(tokens AS BIGINT) AS rest FROM low),
  placed AS (SELECT s.*, e.epoch, q.whole, q.rest, md5('{seed}:' || e.epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
      FROM sized s JOIN quotas q USING (domain, lang, source), (SELECT unnest(range(0, {max_epochs + 1})) AS epoch) e WHERE e.epoch <= q.whole),
  running AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed),
  mixed AS (SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, n_tokens FROM running WHERE epoch < whole OR upto <= rest)"""


MIX_SQL = f"WITH {mixing_ctes().lstrip()}\nSELECT doc_id, domain, lang, source, epoch, CAST(n_tokens AS BIGINT) AS n_tokens FROM mixed"
