"""Main-text extraction by differencing a page with the page of the nearest URL.

Pages of a host are put in the order of their URL paths.  A page's partner is the neighbour in that order whose path
has the longer common beginning (the page before where both are equal): the page most likely made from the same
template.  The text lines of both are aligned by a longest common subsequence, and the lines that they share - menus,
footers, banners - are deleted; what remains is the page's own text.

The neighbours come from one range partitioning of (host, path, id), not from a window per host, so a host with most of
the crawl is spread over all tasks; the rows at the edges of the ranges are patched by a table of one row per range.
A page's markup is parsed twice, so that its text is never kept: the first reading keeps hashes of its lines, and the hashes
of the partner's lines then meet the compressed text of the second reading, by an equi-join on 128 bits of (id, url, html)
that is the same at every size.  So the pages must not change between the readings, which raises.  The alignment is bit-parallel
over Python integers after dropping lines that the other page doesn't have; rows of the dynamic programme are kept at
checkpoints only and recomputed between them, so memory grows with the square root of a page's lines.

Defined cases: a null or empty url, or one without a host, has no partner, like the only page of a host, and keeps all
lines; a null or empty html has no lines; several pages with the same path are neighbours of each other; rows that
repeat in id, url and html count once; rows with the same id but other content are pages of their own; a null id is
kept; an empty table gives an empty result; other columns are ignored.  Host names ignore case; query and fragment
only order pages of equal paths.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.storage import shared_table

SCHEMA = "page_id bigint, partner_id bigint, n_lines int, n_shared int, text string"

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BLOCK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>", re.I
)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")


def lines_of(page: str) -> list[str]:
    """Visible text lines: block tags and line breaks end a line, white space is collapsed, empty lines are dropped."""
    text = _TAG.sub("", _BLOCK.sub("\n", _HIDDEN.sub(" ", page)))
    if "&" in text:
        text = entities.unescape(text)
    return [line for x in text.split("\n") if (line := " ".join(x.split()))]


def shared_lines(own: list, other: list) -> list[int]:
    """Positions in `own` of one longest common subsequence with `other`."""
    there, here = set(other), set(own)
    at = [i for i, x in enumerate(own) if x in there]
    b = [x for x in other if x in here]
    if not at:
        return []
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    step = max(1, math.isqrt(len(at)))

    def row(v: int, i: int) -> int:
        u = v & masks[own[at[i]]]
        return ((v + u) | (v - u)) & full

    kept, v = [full], full  # v after i * step rows; a clear bit is where the subsequence gets longer
    for i in range(len(at)):
        v = row(v, i)
        if (i + 1) % step == 0:
            kept.append(v)
    out, i, j = [], len(at), len(b)
    while i and j:
        base = (i - 1) // step
        rows = [kept[base]]
        for k in range(base * step, i):
            rows.append(row(rows[-1], k))
        while i > base * step and j:
            now, before = rows[i - base * step] >> (j - 1) & 1, rows[i - base * step - 1] >> (j - 1) & 1
            if now:
                j -= 1
            elif not before:
                i -= 1
            else:
                i -= 1
                j -= 1
                out.append(at[i])
    return out[::-1]


def _hashes(lines: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x) for x in lines], dtype=np.uint64)


def _neighbours(urls: DataFrame, ranges: int) -> DataFrame:
    """(key, partner): of the rows before and after in (host, path, url, id, content), the one of longer common path."""
    order = ["host", "path", "url", "page_id", "one", "two", "key"]
    spread = urls.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id())
    spread = shared_table(spread, "page-order")
    w = W.partitionBy("part").orderBy(*order)
    row = F.struct("host", "path", "key")
    near = spread.withColumn("back", F.lag(row).over(w)).withColumn("next", F.lead(row).over(w))
    full = F.struct(*order)
    edges = spread.groupBy("part").agg(F.max(full).alias("last"), F.min(full).alias("first"))
    by = W.orderBy("part")  # one row per range
    edges = edges.select("part", F.lag("last").over(by).alias("before"), F.lead("first").over(by).alias("after"))
    slim = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.host").alias("host"), F.col(f"{c}.path").alias("path"), F.col(f"{c}.key").alias("key")))
    near = near.join(F.broadcast(edges), "part").withColumn("back", F.coalesce("back", slim("before"))).withColumn("next", F.coalesce("next", slim("after")))

    def common(other: str):
        """Characters of the common beginning of both paths, -1 where the host is another."""
        n = F.least(F.length("path"), F.length(f"{other}.path"))
        same = F.aggregate(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
            F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
            lambda a, i: F.struct((a["n"] + F.when(a["on"] & (i <= n) & (F.substr(F.col("path"), i, F.lit(1)) == F.substr(F.col(f"{other}.path"), i, F.lit(1))), 1).otherwise(0)).alias("n"), (a["on"] & (F.substr(F.col("path"), i, F.lit(1)) == F.substr(F.col(f"{other}.path"), i, F.lit(1)))).alias("on")),
            lambda a: a["n"],
        )
        return F.when(F.col(f"{other}.host") == F.col("host"), same).otherwise(-1)

    near = near.withColumn("b", F.coalesce(common("back"), F.lit(-1))).withColumn("n", F.coalesce(common("next"), F.lit(-1)))
    return near.select("key", F.when((F.col("b") >= F.col("n")) & (F.col("b") >= 0), F.col("back.key")).when(F.col("n") >= 0, F.col("next.key")).alias("partner"))


def own_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ranges: int | None = None) -> DataFrame:
    """One row per page: (page_id, partner_id, n_lines, n_shared, text); text has the lines that its partner lacks."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("one", F.xxhash64("page_id", "url", "html")).withColumn("two", F.xxhash64(F.lit(1), "page_id", "url", "html"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = pa.array([_hashes(lines_of(page.as_py())).tobytes() for page in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 3, 4)), lines], names=["page_id", "url", "one", "two", "lines"])

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zipper = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            body = pa.array([zipper.compress("\n".join(lines_of(page.as_py())).encode()) for page in batch.column(0)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), body], names=["one", "two", "body"])

    once = rows.mapInArrow(hashed, "page_id bigint, url string, one bigint, two bigint, lines binary").dropDuplicates(["page_id", "url", "one", "two"])  # rows that repeat count once
    once = shared_table(once.withColumn("key", F.monotonically_increasing_id()), "page-lines")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1))
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    urls = once.select("key", host.alias("host"), path.alias("path"), "url", "page_id", "one", "two").filter("host <> ''")
    partner = _neighbours(urls, ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))).filter("partner IS NOT NULL")
    other = once.select(F.col("key").alias("partner"), F.col("page_id").alias("partner_id"), F.col("lines").alias("other"))
    found = once.select("key", "page_id", "one", "two").join(partner.join(other, "partner"), "key", "left").drop("key", "partner")
    text = rows.select("html", "one", "two").mapInArrow(bodies, "one bigint, two bigint, body binary")
    met = found.join(text, ["one", "two"], "left").dropDuplicates(["one", "two"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            columns: list[list] = [[], [], []]
            for body, other in zip(batch.column(2), batch.column(3)):
                if not body.is_valid:
                    raise ValueError("a page of the first reading isn't in the second")
                text = unzip.decompress(body.as_py()).decode()
                own = text.split("\n") if text else []
                gone = set(shared_lines(_hashes(own).tolist(), np.frombuffer(other.as_py(), np.uint64).tolist())) if other.is_valid else set()
                for c, x in zip(columns, (len(own), len(gone), "\n".join(line for i, line in enumerate(own) if i not in gone))):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], names=["page_id", "partner_id", "n_lines", "n_shared", "text"])

    return met.select("page_id", "partner_id", "body", "other").mapInArrow(cut, SCHEMA)
