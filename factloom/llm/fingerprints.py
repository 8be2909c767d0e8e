"""Context-triggered piecewise hashing: fingerprints of documents and their similarity join.

A rolling hash of the last seven bytes cuts a text where it is -1 modulo the block size (3 * 2**k), so a cut depends on
the nearby bytes only and an edit changes one or two chunks; each chunk gives one of 64 characters.  The block size is the
smallest with at most 64 expected chunks, halved while it finds fewer than 32, and a second signature has twice that
size; whatever follows the 63rd cut is the last chunk, so all of the text counts.  Two fingerprints are compared where
they have a signature of the same block size: score = 100 * (1 - edit distance / sum of lengths), with insertions and
deletions at 1 and changes at 2; a pair needs a common run of seven characters.  similar_fingerprints() also limits the
score for tiny blocks, to block size / 3 * the shorter length, so texts of up to about 192 bytes can't reach MIN_SCORE
there; similar_documents() doesn't, since the common run alone is 42 bits of evidence, and so finds their near copies.

similar_classes() gives one row per document: its class (connected by pairs that reach the score), the number of documents
it pairs with and its best score.  similar_documents() has the pairs themselves, copies expanded.

That last rule is the index: documents meet only in buckets of (block size, seven characters).  What occurs in one
document only is dropped before signatures travel; in the lists that remain, an upper bound of the common subsequence
(a matrix product of letter counts) precedes the exact bit-parallel one.  Lists are read in order, their pairs are made in
blocks and leave as they are found, each from the list of the smallest key that it shares: a worker holds one list, never
its pairs.  Equal fingerprints are collapsed first, so a group of exact copies is one entry everywhere.  No list and no
partner is capped.

Defined cases: null and empty texts have no fingerprint and no row; a signature with fewer than seven characters has no
near partners, and where both of a fingerprint are that short, equal texts (by a hash) are its partners in
similar_documents() and none in similar_fingerprints(); a null id keeps its fingerprint but has no partners; repeated rows count once in pairs and a document never
pairs with itself; other texts that differ but have equal fingerprints score 100 like copies; an empty table gives empty
results; other columns are ignored.  In similar_classes() a document is an id with a fingerprint, and what has no partner, or
no text, is a class of its own with 0 links and a null score; a null id has no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.classes import key_classes
from factloom.llm.common import partitions_for, small_side
from factloom.llm.grams import U, ascending, from_ascending, mix64, squeeze, string_buffers, unsqueeze
from factloom.storage import shared_table

MIN_SCORE = 70
LENGTH = 64
GRAM = 7
BUCKET_ENTRIES = 1_500_000
PAIRS = 1 << 16
SHORT_LIST = 64
SCHEMA = "doc_id bigint, block_size bigint, signature string, signature2 string"
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_CODE = np.zeros(256, np.uint8)
_CODE[_LETTERS] = np.arange(64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_ROLL = [pow(0x01000193, i, 1 << 32) for i in range(GRAM)]


def rolling(raw: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hash of each byte and up to six before it in its row; place: position in the row."""
    x = raw.astype(np.uint32) + np.uint32(1)
    h = x.copy()
    for i in range(1, GRAM):
        h[i:] += np.where(place[i:] >= i, x[:-i], np.uint32(0)) * np.uint32(_ROLL[i])
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h


def _power(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, U)
    p[0] = 1
    return np.multiply.accumulate(p)


def _signature(cuts: np.ndarray, size: int, total: np.ndarray, inverse: np.ndarray) -> str:
    """Letters of the chunks that end after `cuts` (relative to the text)."""
    cuts = cuts[: LENGTH - 1]
    ends = cuts + 1 if len(cuts) and cuts[-1] == size - 1 else np.append(cuts + 1, size)
    starts = np.concatenate(([0], ends[:-1]))
    h = mix64((total[ends] - total[starts]) * inverse[starts] ^ (ends - starts).astype(U) << U(40))
    s = _LETTERS[(h >> U(58)).astype(np.int64)]
    if len(s) > 3:  # a run counts three times at most
        keep = np.ones(len(s), bool)
        keep[3:] = (s[3:] != s[2:-1]) | (s[3:] != s[1:-2]) | (s[3:] != s[:-3])
        s = s[keep]
    return s.tobytes().decode()


def signatures(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, str, str] | None]:
    """(block size, signature, signature of twice the block size) of every row."""
    out: list[tuple[int, str, str] | None] = []
    size = np.diff(offsets)
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], size)
    t = rolling(raw, place).astype(np.int64) + 1
    at = np.flatnonzero(t % 3 == 0)
    third = t[at] // 3
    level = np.log2((third & -third).astype(np.float64)).astype(np.int64)
    bounds = np.searchsorted(at, offsets)
    longest = int(size.max(initial=0))
    power, inverse = _power(_BASE, longest + 1), _power(_INVERSE, longest + 1)
    for i, n in enumerate(size.tolist()):
        if not n:
            out.append(None)
            continue
        text = raw[offsets[i] : offsets[i + 1]]
        total = np.concatenate((np.zeros(1, U), np.cumsum((text.astype(U) + U(1)) * power[:n])))
        where, lv = at[bounds[i] : bounds[i + 1]] - offsets[i], level[bounds[i] : bounds[i + 1]]
        k = 0
        while (3 << k) * LENGTH < n:
            k += 1
        while k and np.count_nonzero(lv >= k) + 1 < LENGTH // 2:
            k -= 1
        out.append((3 << k, _signature(where[lv >= k], n, total, inverse), _signature(where[lv > k], n, total, inverse)))
    return out


def _copy(text: np.ndarray) -> int:
    return int.from_bytes(blake2b(text, digest_size=8).digest(), "little", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", copies: bool = False) -> DataFrame:
    """(doc_id, block_size, signature, signature2) of every document with text.

    With `copies` also copy: a 64-bit hash of the text where both signatures have fewer than seven letters, else 0.
    """
    names = ["doc_id", "block_size", "signature", "signature2", *["copy"] * copies]
    kinds = (pa.int64(), pa.string(), pa.string(), *[pa.int64()] * copies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = string_buffers(batch.column(1))
            got, a = [], 0
            while a < len(batch):  # about a megabyte at a time
                b = min(len(batch), max(a + 1, int(np.searchsorted(offsets, offsets[a] + (1 << 20)))))
                made = signatures(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if copies:
                    made = [g and (*g, _copy(raw[offsets[i] : offsets[i + 1]]) if max(len(g[1]), len(g[2])) < GRAM else 0) for i, g in enumerate(made, a)]
                got += made
                a = b
            keep = pa.array([g is not None for g in got], pa.bool_())
            got = [g for g in got if g]
            columns = [pa.array(c, t) for c, t in zip(zip(*got) if got else [()] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), *columns], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA + ", copy bigint" * copies)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes padded with 64, lengths)."""
    size = np.array([len(t) for t in texts])
    codes = np.full((len(texts), LENGTH), 64, np.uint8)
    codes[np.arange(LENGTH) < size[:, None]] = _CODE[np.frombuffer("".join(texts).encode(), np.uint8)]
    return codes, size


def _keys(codes: np.ndarray, size: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash of block size and seven letters)."""
    h = np.zeros((len(codes), LENGTH - GRAM + 1), U)
    for i in range(GRAM):
        h |= codes[:, i : LENGTH - GRAM + 1 + i].astype(U) << U(6 * i)
    row, col = np.nonzero(np.arange(LENGTH - GRAM + 1) + GRAM <= size[:, None])
    key = mix64(h[row, col] ^ mix64(block.astype(U))[row])
    by = np.lexsort((key, row))
    row, key = row[by], key[by]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[keep], key[keep]


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


ENTRIES = "bucket int, home bigint, keys binary, place binary, reps binary, levels binary, texts binary"


def _entries(buckets: int):
    """A batch of signatures sends (40 bits of the key, place in the batch) to the buckets, and itself along with one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, batch in enumerate(batches, TaskContext.get().partitionId() << 32):
            rep, level, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            row, key = _keys(*_codes(texts), level)
            if not len(key):
                continue
            by = np.argsort(key)
            part, key, row = _bucket(key[by], buckets), key[by] >> U(24), row[by].astype(np.uint32)
            at = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
            rows = [[int(part[x]), home, ascending(key[x:y]), squeeze(row[x:y]), None, None, None] for x, y in zip(at[:-1], at[1:])]
            rows[home % len(rows)][4:] = rep.tobytes(), squeeze(level), zstandard.compress("\n".join(texts).encode(), 1)
            kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["bucket", "home", "keys", "place", "reps", "levels", "texts"])

    return run


def _shared(frame: pd.DataFrame) -> pd.DataFrame:
    """Entries whose key several signatures have, on their way back; of keys with the same list of signatures one is enough."""
    keys, places = [from_ascending(k, U) for k in frame["keys"]], [unsqueeze(p, np.uint32) for p in frame["place"]]
    start = np.cumsum([0, *map(len, keys)])
    origin = np.concatenate([mix64((np.uint64(h) << U(24)) + p.astype(U)) for h, p in zip(frame["home"], places)])
    key = np.concatenate(keys)
    by = np.argsort(key, kind="stable")
    ordered = key[by]
    at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    count = np.diff(np.append(at, len(key)))
    lists = np.add.reduceat(origin[by], at)
    order = np.lexsort((at, count, lists))
    repeat = np.zeros(len(at), bool)
    repeat[order[1:]] = (lists[order[1:]] == lists[order[:-1]]) & (count[order[1:]] == count[order[:-1]])
    keep = np.zeros(len(key), bool)
    keep[by] = np.repeat((count > 1) & ~repeat, count)
    rows = []
    for r, k, p, a, b in zip(frame.itertuples(index=False), keys, places, start[:-1], start[1:]):
        own = keep[a:b]
        if own.any() or r.reps is not None:
            rows.append((r.home, ascending(k[own]), squeeze(p[own]), r.reps, r.levels, r.texts))
    return pd.DataFrame(rows, columns=["home", "keys", "place", "reps", "levels", "texts"])


def _at_home(frame: pd.DataFrame) -> pd.DataFrame:
    """The signatures of a batch with the keys that they share with others."""
    own = frame[frame["reps"].notna()].iloc[0]
    reps, levels = np.frombuffer(own["reps"], np.int64), unsqueeze(own["levels"], np.int64)
    texts = np.array(zstandard.decompress(own["texts"]).decode().split("\n"), dtype=object)
    place = np.concatenate([unsqueeze(p, np.uint32) for p in frame["place"]])
    key = np.concatenate([from_ascending(k, U) for k in frame["keys"]])
    return pd.DataFrame({"gram": key.view(np.int64), "rep": reps[place], "level": levels[place], "text": texts[place]})


def common_subsequence(masks: np.ndarray, size: np.ndarray, codes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of rows x and y (bit-parallel, all pairs at once)."""
    v = np.full(len(x), ~U(0))
    for c in range(int(size[y].max(initial=0))):
        u = v & masks[x, codes[y, c]]
        v = (v + u) | (v - u)
    low = np.where(size[x] >= 64, ~U(0), (U(1) << np.minimum(size[x], 63).astype(U)) - U(1))
    return np.bitwise_count(~v & low).astype(np.int64)


def score_of(common: np.ndarray, a: np.ndarray, b: np.ndarray, level: np.ndarray, limited: bool = True) -> np.ndarray:
    score = 200 * common // (a + b)
    return np.minimum(score, level // 3 * np.minimum(a, b)) if limited else score


def _text_keys(codes: np.ndarray, size: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Ascending 40-bit keys of every signature, each once, padded with the largest number."""
    out = np.full((len(codes), LENGTH - GRAM + 1), ~U(0))
    row, key = _keys(codes, size, block)
    at = np.searchsorted(row, np.arange(len(codes)))
    out[row, np.arange(len(row)) - at[row]] = key >> U(24)
    return out


def _least_common(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The smallest key that both rows have (each pair has one)."""
    both = np.sort(np.concatenate((one, two), axis=1), axis=1)
    first = (both[:, 1:] == both[:, :-1]).argmax(axis=1)
    return both[np.arange(len(both)), first]


def _unary(letters: np.ndarray, most: int) -> np.ndarray:
    return np.concatenate([(letters > k).astype(np.float32) for k in range(most)], axis=1)


def _list_hits(gram: np.ndarray, rep: np.ndarray, level: np.ndarray, text: pa.Array, min_score: int, limited: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rep_a, rep_b, score) of the pairs within each list of entries with equal gram, up to 65,536 at a time.

    A pair that shares several keys is reported in the list of the smallest one only.
    """
    words = text.dictionary_encode()
    _, first, entry = np.unique(words.indices.to_numpy().astype(np.int64) + level * len(words.dictionary), return_index=True, return_inverse=True)
    codes, size = _codes(text.take(pa.array(first)).to_pylist())
    masks = np.zeros((len(first), 65), U)
    for c in range(LENGTH):
        inside = np.flatnonzero(size > c)
        masks[inside, codes[inside, c]] |= U(1) << U(c)
    letters = np.zeros((len(first), 64), np.uint8)
    np.add.at(letters, (np.nonzero(codes < 64)[0], codes[codes < 64]), 1)
    keys = _text_keys(codes, size, level[first])
    gram = gram.view(U)

    def hits(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for s in range(0, len(i), PAIRS):
            p, q = i[s : s + PAIRS], j[s : s + PAIRS]
            keep = (rep[p] != rep[q]) & (level[p] == level[q])
            for m in range(4):  # most pairs with a smaller common key are known by their four smallest
                k = keys[entry[p], m]
                same = (k[:, None] == keys[entry[q], :4]).any(axis=1)
                keep &= ~(same & (k < gram[p]))
            p, q = p[keep], q[keep]
            x, y = entry[p], entry[q]
            score = score_of(common_subsequence(masks, size, codes, x, y), size[x], size[y], level[p], limited)
            hit = np.flatnonzero(score >= min_score)
            parts = [hit[k : k + 4096] for k in range(0, len(hit), 4096)]
            own = [h[_least_common(keys[x[h]], keys[y[h]]) == gram[p[h]]] for h in parts]
            for h in [np.concatenate(own)] if own else []:
                yield np.minimum(rep[p[h]], rep[q[h]]), np.maximum(rep[p[h]], rep[q[h]]), score[h]

    def near(x: np.ndarray, y: np.ndarray, common: np.ndarray) -> np.ndarray:
        return 2 * common >= np.float32(min_score / 100) * (size[x] + size[y]).astype(np.float32) - np.float32(1e-3)

    at = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    count = np.diff(np.append(at, len(gram)))
    left = np.repeat(at + count, count) - np.arange(len(gram))  # entries from here to the end of the list
    left[np.repeat(count > SHORT_LIST, count)] = 0
    for d in range(1, min(SHORT_LIST, int(left.max(initial=0)))):
        every = np.flatnonzero(left > d)
        for s in range(0, len(every), PAIRS):
            i = every[s : s + PAIRS]
            x, y = entry[i], entry[i + d]
            i = i[near(x, y, np.minimum(letters[x], letters[y]).sum(axis=1, dtype=np.int64))]
            yield from hits(i, i + d)
    for lo, hi in zip(at[count > SHORT_LIST], (at + count)[count > SHORT_LIST]):
        # the product of two rows of unary letter counts bounds their common subsequence from above
        most = int(letters[entry[lo:hi]].max())
        for a in range(lo, hi, 512):
            x = entry[a : min(a + 512, hi)]
            left_side = _unary(letters[x], most)
            for b in range(a, hi, 2048):
                y = entry[b : min(b + 2048, hi)]
                i, j = np.nonzero(near(x[:, None], y[None, :], left_side @ _unary(letters[y], most).T))
                i, j = a + i, b + j
                yield from hits(i[i < j], j[i < j])


def _compare(min_score: int, limited: bool):
    """Pairs of entries that come ordered by gram; held at a time are a batch, the longest list and a block of its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            if len(t):
                found = _list_hits(*(t.column(c).to_numpy() for c in range(3)), t.column(3).combine_chunks(), min_score, limited)
                for some in found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in some], names=["rep_a", "rep_b", "score"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            gram = batch.column(0).to_numpy()
            if held and held[-1].column(0)[0].as_py() == gram[-1]:
                held.append(batch)  # of the same list
                continue
            cut = int(np.searchsorted(gram, gram[-1]))
            yield from pairs([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        if held:
            yield from pairs(held)

    return run


def similar_fingerprints(docs: DataFrame, min_score: int = MIN_SCORE, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """All pairs doc_a < doc_b with signatures of seven letters or more that score min_score (1 to 100) or more: (doc_a, doc_b, score)."""
    return _pairs(fingerprints(docs).filter("doc_id IS NOT NULL AND length(signature) >= 7"), ["block_size", "signature", "signature2"], min_score, bucket_entries, limited=True)


SAME = ["block_size", "signature", "signature2", "copy"]


def _keyed(docs: DataFrame) -> DataFrame:
    return fingerprints(docs.filter("doc_id IS NOT NULL"), copies=True)


def similar_documents(docs: DataFrame, min_score: int = MIN_SCORE, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """similar_fingerprints() without the limit for tiny blocks, and copies of the texts whose signatures are too short for it."""
    return _pairs(_keyed(docs), SAME, min_score, bucket_entries, limited=False)


def similar_classes(docs: DataFrame, min_score: int = MIN_SCORE, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """(doc_id, class_id, n_links, best_score) of every document, by the pairs of similar_documents()."""
    members, found = _found(_keyed(docs), SAME, min_score, bucket_entries, limited=False)
    n = small_side(shared_table(members.groupBy("rep").agg(F.count("*").alias("n")), "fingerprint-copies"))
    found = shared_table(found, "fingerprint-pairs")
    both = found.select(F.col("rep_a").alias("rep"), F.col("rep_b").alias("key"), "score").unionByName(found.select(F.col("rep_b").alias("rep"), F.col("rep_a").alias("key"), "score"))
    sums = both.join(n, "rep").groupBy("key").agg(F.sum("n").alias("links"), F.max("score").cast("double").alias("best"))
    per = key_classes(members.select(F.col("doc_id").alias("id"), F.col("rep").alias("key")), sums, found.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    per = small_side(shared_table(per.select("key", "n", "links", "best", "class_id"), "fingerprint-classes"))
    best = F.when(F.col("n") > 1, 100).otherwise(F.col("best")).cast("int")
    rows = members.join(per, members["rep"] == per["key"]).select("doc_id", "class_id", F.col("links").alias("n_links"), best.alias("best_score"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length(F.col("text").cast("string")) > 0, F.lit(False)).alias("some")).filter("doc_id IS NOT NULL AND NOT some").distinct()
    return rows.unionByName(ids.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("int").alias("best_score")))


def _found(prints: DataFrame, same: list[str], min_score: int, bucket_entries: int, limited: bool) -> tuple[DataFrame, DataFrame]:
    """((doc_id, rep) of all documents, (rep_a, rep_b, score) of different fingerprints); those equal in the columns `same` are one rep."""
    prints = shared_table(prints, "fingerprints")
    reps = prints.select(*same).distinct().withColumn("rep", F.monotonically_increasing_id())  # numbers, not hashes: none coincide
    reps = shared_table(reps, "fingerprint-reps")
    levels = F.array(F.struct(F.col("block_size").alias("level"), F.col("signature").alias("text")), F.struct((F.col("block_size") * 2).alias("level"), F.col("signature2").alias("text")))
    levels = reps.select("rep", F.inline(levels)).filter("length(text) >= 7")
    buckets = partitions_for(reps.count() * 60, bucket_entries)
    shared = levels.mapInArrow(_entries(buckets), ENTRIES).groupBy("bucket").applyInPandas(_shared, "home bigint, keys binary, place binary, reps binary, levels binary, texts binary")
    met = shared.groupBy("home").applyInPandas(_at_home, "gram bigint, rep bigint, level bigint, text string")
    met = met.repartition(4 * buckets, "gram").sortWithinPartitions("gram")
    found = met.mapInArrow(_compare(min_score, limited), "rep_a bigint, rep_b bigint, score bigint").repartition("rep_a").groupBy("rep_a", "rep_b").agg(F.max("score").alias("score"))
    members = prints.select("doc_id", *same).distinct().join(small_side(reps, 256), same).select("doc_id", "rep")
    return shared_table(members, "fingerprint-members"), found


def _pairs(prints: DataFrame, same: list[str], min_score: int, bucket_entries: int, limited: bool) -> DataFrame:
    """Pairs of documents, copies expanded."""
    members, found = _found(prints, same, min_score, bucket_entries, limited)
    one = small_side(members.select(F.col("doc_id").alias("x"), F.col("rep").alias("rep_a")))
    two = small_side(members.select(F.col("doc_id").alias("y"), F.col("rep").alias("rep_b")))
    copies = one.join(two, F.expr("rep_a = rep_b AND x < y")).select("x", "y", F.lit(100).cast("long").alias("score"))
    near = found.join(one, "rep_a").join(two, "rep_b").filter("x <> y").select("x", "y", "score")
    pairs = copies.unionByName(near).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), F.col("score").cast("int").alias("score"))
    if members.count() == members.select("doc_id").distinct().count():
        return pairs  # one fingerprint per id: no pair comes twice
    return pairs.groupBy("doc_a", "doc_b").agg(F.max("score").alias("score"))
