"""Exact n-gram Jaccard self-join with prefix filters under several global token orders.

A document is the set of its word n-grams.  Two sets of sizes a, b with Jaccard >= t share a token within the first
p = a - ceil(t*a) + 1 and q = b - ceil(t*b) + 1 tokens under *every* total order of all tokens.  So a candidate must
share a prefix token under each of ORDERS orders, and only the intersection of those filters is verified.

1.  Equal texts are collapsed: one of them goes on, with the number of its copies.
2.  Order 0 is rare-first over the whole corpus.  Every text's grams go to token buckets, packed as (fingerprint, text)
    arrays of a few bytes a gram; a bucket knows which grams occur in more than one text.  A gram of one text can't
    match, so it stays home - but it takes up a place at the front of its text's prefix, which empties the prefix of
    most texts.
3.  What repeats returns to its text, which cuts its prefix; prefix tokens go to buckets again, and texts that share
    one are linked if the tokens left behind it could still make them similar.  A linked component holds every pair
    that passes the order-0 filter.
4.  The texts of a component meet in one task.  A component of more than `block_rows` texts or BLOCK_CHARS characters is
    cut into blocks, by the smallest prefix token so that similar texts are mostly in one, and a text goes to another
    block only if it shares a prefix token with a text there: what travels follows the candidates, not the square of
    the component.  In the task the prefix filters of all orders are computed and intersected, and the survivors are
    verified exactly on 64-bit gram hashes.  A pair meets in exactly one task.

Compressed texts are what travels: a gram set of 8 bytes a word would be about three times as large.  Everything is
partitioned by hashed gram or text; nothing is broadcast but keys below a checked size.  There is no cap on how often a
gram may occur or on partners.

`classes` gives one row per document: its class, the number of documents it is linked to, and the best similarity;
tasks sum links up as they find them, so a group costs rows in proportion to its documents.  `similar_pairs` expands
copies into all pairs, whose number is quadratic in a group.

Texts are named on the way by their task, batch and place, so they are written once before.

Defined cases: a document is an id with a text, so repeated rows count once, and an id with several texts has a row for
each of them, which are compared like those of other ids (similar_pairs() has no pair of an id with itself and the best
similarity of two ids); null, empty and blank texts have no grams and no partners (a class of their own, 0 links, null
similarity); a text of fewer than n words is one gram; rows with a null id are ignored; an empty table gives an empty
result; other columns are ignored.  Case is ignored, white space separates words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.classes import key_classes
from factloom.llm.common import partitions_for, small_side
from factloom.llm.grams import ascending, from_ascending, gram_sets, mix64, squeeze, string_buffers, unsqueeze
from factloom.operators.components import connected_components
from factloom.storage import shared_table

N = 3
THRESHOLD = 0.5
ORDERS = 3
BUCKET_GRAMS = 2_000_000
BLOCK_ROWS = 2000
BLOCK_CHARS = 4_000_000
HOME_BYTES = 16 << 20
PAIRS = "key_a bigint, key_b bigint, jaccard double"
SUMS = "key bigint, other bigint, links bigint, best double"
U = np.uint64


def prefix_length(size: np.ndarray, threshold: float) -> np.ndarray:
    """Tokens of the prefix; the small term keeps rounding from making it too short."""
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1


def _pack(keys: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Documents of a payload (once each), their sizes, and for every entry the place of its document."""
    there = np.zeros(len(keys), bool)
    there[at] = True
    return keys[there].tobytes(), squeeze(sizes[there].astype(np.uint32)), squeeze((np.cumsum(there) - 1)[at].astype(np.uint32))


def _cuts(part: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """Runs of equal values in a sorted array."""
    edges = np.searchsorted(part, np.arange(parts + 1)) if parts < len(part) else None
    if edges is not None:
        for i in np.flatnonzero(np.diff(edges)):
            yield int(i), slice(edges[i], edges[i + 1])
    elif len(part):
        at = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
        for x, y in zip(at[:-1], at[1:]):
            yield int(part[x]), slice(x, y)


def _split(h: np.ndarray, parts: int) -> np.ndarray:
    """Bucket of a 64-bit hash, from its high half."""
    return ((h >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about HOME_BYTES of text, or one text, so that what a worker holds doesn't grow with the texts of a batch."""
    for batch in batches:
        offsets, _ = string_buffers(batch.column(1))
        a = 0
        while a < len(batch):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + HOME_BYTES)))
            yield batch.slice(a, b - a)
            a = b


GRAM_ROWS = "bucket int, home bigint, place binary, prints binary, keys binary, sizes binary"


def _grams_out(n: int, buckets: int):
    """A batch of documents sends its grams to the buckets, and its keys along with one of them (for the way back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for home, batch in enumerate(_pieces(batches), first):
            h, at = gram_sets(batch.column(1), n)
            if not len(h):
                continue
            keys, sizes = batch.column(0).to_numpy(zero_copy_only=False), np.diff(at)
            row = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
            part = _split(h, buckets)
            by = np.argsort(part.astype(U) << U(32) | h & U(0xFFFFFFFF))
            part, row, prints = part[by], row[by], h.astype(np.uint32)[by]
            rows = [[b, home, squeeze(row[s]), ascending(prints[s]), None, None] for b, s in _cuts(part, buckets)]
            rows[home % len(rows)][4:] = keys.tobytes(), squeeze(sizes.astype(np.uint32))
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["bucket", "home", "place", "prints", "keys", "sizes"])

    return run


REPEATED = "home bigint, bucket int, place binary, prints binary, classes binary, keys binary, sizes binary"


def _repeated(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Grams of a bucket that several documents have, on their way back to the documents."""
    prints = [from_ascending(x, np.uint32) for x in frame["prints"]]
    start = np.cumsum([0, *map(len, prints)])
    prints = np.concatenate(prints)
    by = np.argsort(prints, kind="stable")
    ordered = prints[by]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    count = np.diff(np.append(first, len(ordered)))
    classes = np.zeros(len(prints), np.uint8)
    classes[by] = np.repeat(np.where(count > 1, np.minimum(255, np.log2(count) * 8), 0).astype(np.uint8), count)
    rows = []
    for r, a, b in zip(frame.itertuples(index=False), start[:-1], start[1:]):
        keep = classes[a:b] > 0
        if keep.any() or r.keys is not None:
            rows.append((r.home, key[0], squeeze(unsqueeze(r.place, np.uint32)[keep]), ascending(prints[a:b][keep]), squeeze(classes[a:b][keep]), r.keys, r.sizes))
    return pd.DataFrame(rows, columns=["home", "bucket", "place", "prints", "classes", "keys", "sizes"])


PREFIXES = "part int, keys binary, sizes binary, place binary, grams binary, remaining binary"


def _prefixes(threshold: float, parts: int):
    """Prefix tokens (order 0) of the documents at home here, on their way to the tokens."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[frame["keys"].notna()].iloc[0]
        all_keys, all_sizes = np.frombuffer(own["keys"], np.int64), unsqueeze(own["sizes"], np.uint32)
        key, size, gram, rank = [], [], [], []
        for r in frame.itertuples(index=False):
            place = unsqueeze(r.place, np.uint32)
            key.append(all_keys[place])
            size.append(all_sizes[place])
            g = from_ascending(r.prints, np.uint32).astype(U) | U(r.bucket) << U(32)
            gram.append(g)
            rank.append(unsqueeze(r.classes, np.uint8).astype(U) << U(56) | mix64(g) >> U(8))
        key, size, gram, rank = map(np.concatenate, (key, size, gram, rank))
        if not len(key):
            return pd.DataFrame([], columns=["part", "keys", "sizes", "place", "grams", "remaining"])
        by = np.lexsort((rank, key))
        key, size, gram = key[by], size[by].astype(np.int64), gram[by]
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.concatenate((at, [len(key)])))
        place = np.arange(len(key)) - np.repeat(at, count) + size - np.repeat(count, count)  # grams of this document only come first
        keep = place < prefix_length(size, threshold)
        key, gram, size, remaining = key[keep], gram[keep], size[keep], (size - place)[keep]
        keys, first, doc = np.unique(key, return_index=True, return_inverse=True)
        sizes, part = size[first], _split(mix64(gram), parts)
        by = np.lexsort((gram, part))
        part, gram, doc, remaining = part[by], gram[by], doc[by], remaining[by].astype(np.uint32)
        rows = [(p, *_pack(keys, sizes, doc[s]), ascending(gram[s]), squeeze(remaining[s])) for p, s in _cuts(part, parts)]
        return pd.DataFrame(rows, columns=["part", "keys", "sizes", "place", "grams", "remaining"])

    return run


def _links(threshold: float):
    """Edges between documents that share a prefix token and may still be similar by the token's places.

    If a pair's first common token leaves r and s tokens (itself included) to sets of sizes a and b, they have at most
    min(r, s) tokens in common and need t / (1 + t) * (a + b).  So r limits the size of a partner ("reach").  Of the
    documents that reach their own size, by size, each is linked to the earlier one that admits the largest partner, if
    it admits this one.  That connects all of them that may pair: what an earlier x admits is admitted by the widest one
    too, and so is x itself or, if the widest comes after x, that one by x or by a still earlier one.  Each other
    document is linked to those of them that it may pair with.
    """
    share = threshold / (1 + threshold)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        key, size, gram, left = [], [], [], []
        for r in frame.itertuples(index=False):
            place = unsqueeze(r.place, np.uint32)
            key.append(np.frombuffer(r.keys, np.int64)[place])
            size.append(unsqueeze(r.sizes, np.uint32)[place])
            gram.append(from_ascending(r.grams, U))
            left.append(unsqueeze(r.remaining, np.uint32))
        key, size, gram, left = map(np.concatenate, (key, size, gram, left))
        size = size.astype(np.int64)
        by = np.lexsort((key, size, gram))
        key, size, gram, left = key[by], size[by], gram[by], left[by].astype(np.float64)
        reach = left / share - size + 1e-6
        most = np.minimum(reach, size / threshold + 1e-6)
        good = np.flatnonzero(reach >= size)
        edges = [np.zeros((0, 2), np.int64)]

        def link(x: np.ndarray, y: np.ndarray) -> None:
            e = np.stack((np.minimum(key[x], key[y]), np.maximum(key[x], key[y])), 1)
            edges.append(e[e[:, 0] != e[:, 1]])

        # running maximum of (list, rank of most): the lists come in order, so each starts anew
        fresh = np.ones(len(good), np.int64)
        fresh[1:] = gram[good[1:]] != gram[good[:-1]]
        widest = np.argsort(most[good], kind="stable")
        rank = np.empty(len(good), np.int64)
        rank[widest] = np.arange(len(good))
        so_far = np.maximum.accumulate(np.cumsum(fresh) * len(good) + rank)[:-1]
        x, y = good[widest[so_far % max(1, len(good))]], good[1:]
        admitted = (gram[x] == gram[y]) & (size[y] <= most[x])
        link(x[admitted], y[admitted])
        # the others, each with the good ones of sizes threshold * size to its reach, in the same list
        other = np.flatnonzero(reach < size)
        place = np.cumsum(np.concatenate(([0], (reach >= size).astype(np.int64))))  # good ones before an entry
        at = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        start = np.repeat(at, np.diff(np.append(at, len(gram))))
        mark = np.unique(gram, return_inverse=True)[1].astype(np.float64) * (1 << 32) + size  # (list, size), exact below 2**53
        base = mark[other] - size[other]
        low = np.searchsorted(mark, base + np.ceil(threshold * size[other] - 1e-6))
        high = np.searchsorted(mark, base + np.floor(np.maximum(reach[other], 0)), side="right")
        low, high = place[np.maximum(low, start[other])], place[np.maximum(high, start[other])]
        some = np.flatnonzero(high > low)
        n, a = (high - low)[some], 0
        total = np.concatenate(([0], np.cumsum(n)))
        while a < len(some):
            b = max(a + 1, int(np.searchsorted(total, total[a] + (1 << 21), side="right")) - 1)
            m = n[a:b]
            x = good[np.repeat(low[some[a:b]] - (total[a:b] - total[a]), m) + np.arange(m.sum())]
            y = np.repeat(other[some[a:b]], m)
            ok = size[y] <= most[x]
            link(x[ok], y[ok])
            if len(edges) > 64:
                edges[:] = [np.unique(np.concatenate(edges), axis=0)]
            a = b
        found = np.concatenate(edges)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]}).drop_duplicates()

    return run


def _entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(gram, key) of packed prefix tokens."""
    for frame in frames:
        for r in frame.itertuples(index=False):
            yield pd.DataFrame({"gram": from_ascending(r.grams, U).view(np.int64), "key": np.frombuffer(r.keys, np.int64)[unsqueeze(r.place, np.uint32)]})


def _candidates(sets: list[np.ndarray], orders: list[np.ndarray], size: np.ndarray, side: np.ndarray, threshold: float, vocabulary: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, candidates j > i of the other side): they share a prefix token under every order. Side -1 is on either side."""
    prefix = prefix_length(size, threshold)
    filters = []
    for rank in orders:
        heads = [s[np.argpartition(rank[s], p - 1)[:p]] if p < len(s) else s for s, p in zip(sets, prefix)]
        token, doc = np.concatenate(heads), np.repeat(np.arange(len(sets)), [len(x) for x in heads])
        by = np.argsort(token, kind="stable")
        at = np.concatenate(([0], np.cumsum(np.bincount(token, minlength=vocabulary))))
        filters.append((heads, doc[by], at))
    for i in range(len(sets)):
        ok = size >= threshold * size[i] - 1e-9
        ok &= size[i] >= threshold * size - 1e-9
        ok &= (side != side[i]) | (side < 0)
        ok[: i + 1] = False
        for heads, posting, at in filters:
            if not ok.any():
                break
            token = heads[i]
            n = at[token + 1] - at[token]
            where = np.repeat(at[token] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            ok &= np.bincount(posting[where], minlength=len(sets)) > 0
        j = np.flatnonzero(ok)
        if len(j):
            yield i, j


def join_sets(sets: list[np.ndarray], threshold: float, orders: int = ORDERS, side: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, partners j > i, their Jaccard similarities) over non-empty sets of 64-bit hashes; of two sides, pairs across only."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    words, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    cut = np.cumsum(size)[:-1]
    local = np.split(token, cut)
    ranks = []
    for k in range(orders):
        # 0: rare first, hash breaks ties; others: frequency classes of growing width, each with its own hash order
        rank = np.empty(len(words), np.int64)
        coarse = often if k == 0 else np.floor(np.log2(often) / k).astype(np.int64)
        rank[np.lexsort((mix64(words ^ U(0x9E37 * (k + 1))), coarse))] = np.arange(len(words))
        ranks.append(rank)
    mark = np.zeros(len(words), bool)
    bounds = np.concatenate(([0], np.cumsum(size)))
    for i, j in _candidates(local, ranks, size, np.full(len(sets), -1) if side is None else side, threshold, len(words)):
        mark[local[i]] = True
        n = size[j]
        where = np.repeat(bounds[j] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        same = np.add.reduceat(mark[token[where]].astype(np.int64), np.concatenate(([0], np.cumsum(n)[:-1])))
        mark[local[i]] = False
        score = same / (size[i] + n - same)
        hit = score >= threshold
        if hit.any():
            yield i, j[hit], score[hit]


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for their way to the task that compares them."""
    zipper = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array([zipper.compress(t.as_py().encode()) for t in batch.column("text")], pa.binary()))


def _verify(n: int, threshold: float, orders: int, sums: bool):
    """The links of a task: all of them as pairs, or summed up per key, with the links of a spanning forest."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, first = np.unique(table.column("key").to_numpy(), return_index=True)  # repeated rows of a document come once
        copies, block = table.column("n").to_numpy()[first], table.column("block").to_numpy()[first]
        unzip, texts = zstandard.ZstdDecompressor(), table.column("text")
        h, at = gram_sets(pa.array([unzip.decompress(texts[int(r)].as_py()) for r in first], pa.binary()), n)
        some = np.flatnonzero(np.diff(at))
        ids, copies, block = ids[some], copies[some], block[some]
        sets = [h[at[r] : at[r + 1]] for r in some]
        found = join_sets(sets, threshold, orders, None if key[1].as_py() == key[2].as_py() else block) if sets else ()
        if not sums:
            out = [(np.full(len(j), i), j, s) for i, j, s in found] or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            a, b, score = map(np.concatenate, zip(*out))
            return pa.table({"key_a": ids[a], "key_b": ids[b], "jaccard": score})
        links, best, top = np.zeros(len(sets), np.int64), np.zeros(len(sets)), np.arange(len(sets))

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        for i, j, s in found:
            links[i] += copies[j].sum()
            links[j] += copies[i]
            best[i] = max(best[i], s.max())
            best[j] = np.maximum(best[j], s)
            for r in {find(x) for x in np.unique(top[j]).tolist()}:
                top[r] = find(i)
        hit = np.flatnonzero(links)
        return pa.table({"key": ids[hit], "other": ids[np.array([find(x) for x in hit.tolist()], np.int64)], "links": links[hit], "best": best[hit]})

    return run


def _texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, one, two, key) of every document, (key, n, chars, text) of every distinct text that isn't blank).

    one and two are 128 bits of hash of the lower-cased text; key numbers the texts.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text")).filter("doc_id IS NOT NULL")
    slim = slim.select("doc_id", F.xxhash64("text").alias("one"), F.xxhash64(F.lit(1), "text").alias("two"), "text", F.coalesce(F.col("text").rlike("[^ \\t\\n\\r\\f\\x0B]"), F.lit(False)).alias("solid"))
    ids = shared_table(slim.select("doc_id", "one", "two", "solid").distinct(), "jaccard-ids")
    leaders = ids.groupBy("one", "two", "solid").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    leaders = shared_table(leaders.withColumn("key", F.monotonically_increasing_id()), "jaccard-leaders")
    members = shared_table(ids.join(small_side(leaders.select("one", "two", "solid", "key")), ["one", "two", "solid"]), "jaccard-members")
    chosen = small_side(leaders.filter("solid").select("doc_id", "one", "two", "key", "n"))
    texts = slim.filter("solid").join(chosen, ["doc_id", "one", "two"]).select("key", "n", F.length("text").alias("chars"), "text")
    return members, shared_table(texts, "jaccard-texts", compression="zstd")


def _met(texts: DataFrame, n: int, threshold: float, block_rows: int, block_chars: int, bucket_grams: int) -> DataFrame:
    """(component, i, j, block, key, n, text): the texts of the linked components, where they meet."""
    chars = texts.agg(F.sum("chars")).first()[0] or 0
    buckets = partitions_for(chars / 6, bucket_grams)  # about 6 characters a word; only sizes the buckets
    parts = partitions_for(chars / 6, 8 * bucket_grams)  # prefix tokens are a small part of all
    back = texts.select("key", "text").mapInArrow(_grams_out(n, buckets), GRAM_ROWS).groupBy("bucket").applyInPandas(_repeated, REPEATED)
    heads = shared_table(back.groupBy("home").applyInPandas(_prefixes(threshold, parts), PREFIXES), "jaccard-prefixes")
    linked = connected_components(heads.groupBy("part").applyInPandas(_links(threshold), "a bigint, b bigint")).withColumnRenamed("node", "key")
    linked = shared_table(linked.join(texts.select("key", "chars"), "key"), "jaccard-linked")
    size = linked.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / block_rows, F.sum("chars") / block_chars)).cast("int").alias("blocks"))
    sized = shared_table(linked.join(size, "component").select("key", "component", "blocks"), "jaccard-sized")
    zero = F.lit(0)
    at = sized.filter("blocks = 1").select("key", "component", zero.alias("block"), zero.alias("i"), zero.alias("j"))
    large = sized.filter("blocks > 1")
    if not large.isEmpty():
        entries = heads.select("grams", "keys", "place").mapInPandas(_entries, "gram bigint, key bigint").join(large, "key")
        entries = shared_table(entries, "jaccard-entries")
        first = entries.groupBy("key", "component", "blocks").agg(F.min("gram").alias("first"))
        often = first.groupBy("component", "first").agg(F.ceil(F.count("*") / block_rows).alias("spread"))
        block = F.pmod(F.xxhash64("first") + F.pmod(F.xxhash64("key"), "spread"), "blocks").cast("int")
        block = shared_table(first.join(often, ["component", "first"]).select("key", "component", block.alias("block")), "jaccard-blocks")
        entries = entries.select("gram", "key").join(block, "key")
        others = entries.groupBy("gram").agg(F.collect_set("block").alias("others"))  # as many as there are blocks at most
        pairs = entries.join(others, "gram").select("key", "component", "block", F.explode("others").alias("other")).distinct()
        at = at.unionByName(pairs.select("key", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    at = small_side(shared_table(at, "jaccard-places"))  # keys of the linked texts, when few enough
    met = texts.join(at, "key").select("component", "i", "j", "block", "key", "n", "text")
    return met.mapInArrow(_zipped, "component bigint, i int, j int, block int, key bigint, n bigint, text binary")


def similar_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, orders: int = ORDERS, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS, bucket_grams: int = BUCKET_GRAMS) -> DataFrame:
    """All pairs doc_a < doc_b with Jaccard similarity >= threshold, once each; copies are expanded."""
    members, texts = _texts(docs)
    met = _met(texts, n, threshold, block_rows, block_chars, bucket_grams)
    found = met.groupBy("component", "i", "j").applyInArrow(_verify(n, threshold, orders, sums=False), PAIRS)
    one = members.filter("solid").select(F.col("key").alias("key_a"), F.col("doc_id").alias("x"))
    two = members.filter("solid").select(F.col("key").alias("key_b"), F.col("doc_id").alias("y"))
    copies = one.join(two, F.expr("key_a = key_b AND x < y")).select("x", "y", F.lit(1.0).alias("jaccard"))
    pairs = found.join(one, "key_a").join(two, "key_b").filter("x <> y").select("x", "y", "jaccard").unionByName(copies)
    return pairs.groupBy(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).agg(F.max("jaccard").alias("jaccard"))


def _classed(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, orders: int = ORDERS, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS, bucket_grams: int = BUCKET_GRAMS) -> DataFrame:
    """The members of _texts() with class_id, keeper (key), links and best."""
    members, texts = _texts(docs)
    met = _met(texts, n, threshold, block_rows, block_chars, bucket_grams)
    sums = shared_table(met.groupBy("component", "i", "j").applyInArrow(_verify(n, threshold, orders, sums=True), SUMS), "jaccard-sums")
    solid = members.filter("solid").select(F.col("doc_id").alias("id"), "key")
    per = key_classes(solid, sums.select("key", "links", "best"), sums.select(F.col("key").alias("a"), F.col("other").alias("b")))
    return members.join(small_side(shared_table(per.select("key", "links", "best", "class_id", "keeper"), "jaccard-classes")), "key", "left")


def classes(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, class_id, n_links, best_jaccard) of every document; class_id is the smallest id of its class."""
    return _classed(docs, **parameters).select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.col("best").alias("best_jaccard"))


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs, all columns, without the members of similar classes but each class's first (by id).

    Of several rows with one id the first in the order of their columns stays; rows with a null id stay.
    """
    found = _classed(docs, **parameters).filter("class_id IS NOT NULL AND (class_id <> doc_id OR keeper <> key)")
    gone = small_side(shared_table(found.select(F.col("doc_id").alias("_gone"), F.col("one").alias("_one"), F.col("two").alias("_two")), "jaccard-gone"))
    text = F.lower(docs["text"].cast("string"))
    on = (docs["doc_id"].cast("long") == gone["_gone"]) & (F.xxhash64(text) == gone["_one"]) & (F.xxhash64(F.lit(1), text) == gone["_two"])
    kept = docs.join(gone, on, "left_anti")
    again = shared_table(docs.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_again")).count().filter("count > 1").select("_again"), "jaccard-again")
    if again.isEmpty():
        return kept
    again = small_side(again)
    repeated = kept.join(again, kept["doc_id"].cast("long") == again["_again"], "left_semi")
    first = repeated.groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.struct(*repeated.columns)).alias("_row")).select("_row.*")
    return kept.join(again, kept["doc_id"].cast("long") == again["_again"], "left_anti").unionByName(first)


def pairs_ctes(docs: str = "documents", n: int = N, threshold: float = THRESHOLD) -> str:
    """CTEs that end in `alike`, the rows of similar_pairs(); DuckDB."""
    gram = " || ' ' || ".join(f"t[i + {k}]" if k else "t[i]" for k in range(n))
    return f"""
  words AS (SELECT doc_id, [x FOR x IN string_split_regex(lower(text), '[ \\t\\n\\r\\f\\v]+') IF x <> ''] AS t FROM {docs} WHERE doc_id IS NOT NULL AND text IS NOT NULL),
  grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= {n} THEN [{gram} FOR i IN range(1, len(t) - {n - 2})] ELSE [array_to_string(t, ' ')] END) AS g FROM words WHERE len(t) > 0),
  sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
  common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
  alike AS (SELECT a AS doc_a, b AS doc_b, CAST(c AS DOUBLE) / (p.n + q.n - c) AS jaccard FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE CAST(c AS DOUBLE) / (p.n + q.n - c) >= {threshold})"""


CLASSES_SQL = f"""WITH RECURSIVE {pairs_ctes().lstrip()},
  links AS (SELECT doc_a AS a, doc_b AS b, jaccard FROM alike UNION ALL SELECT doc_b, doc_a, jaccard FROM alike),
  near(a, b) AS (SELECT doc_id, doc_id FROM documents WHERE doc_id IS NOT NULL UNION SELECT near.a, links.b FROM near JOIN links ON near.b = links.a),
  tops AS (SELECT a AS doc_id, min(b) AS class_id FROM near GROUP BY a),
  counts AS (SELECT a AS doc_id, count(*) AS n_links, max(jaccard) AS best_jaccard FROM links GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, best_jaccard FROM tops LEFT JOIN counts USING (doc_id)"""
