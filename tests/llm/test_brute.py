"""Operators that SQL can't express, against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import gzip
import io
import os
import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from factloom.llm import fingerprints, grams, jaccard, mixing, neardup, packing, pages, quality, queries, toxicity, warc
from factloom.llm.common import table
from tests.session import SF


def subsequence(a, b) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def sum_of_squares(sizes: list[int], window: int) -> list[tuple[int, int]]:
    """(window, start) by trying every placement and recounting the squares. The fullest of equal levels wins, then an open window."""
    filled: list[int] = []
    out = []
    for s in sizes:
        best = None
        for level in sorted({f for f in filled if f + s <= window}, reverse=True) + [0]:
            trial = list(filled)
            if level:
                trial[len(trial) - 1 - trial[::-1].index(level)] = level + s
            else:
                trial.append(s)
            count = {}
            for f in trial:
                if f < window:
                    count[f] = count.get(f, 0) + 1
            cost = sum(n * n for n in count.values())
            if best is None or cost < best[0]:
                best = cost, level
        level = best[1]
        if level:
            # the last window that reached this level
            at = last_at[level].pop()
        else:
            at = len(filled)
            filled.append(0)
        filled[at] = level + s
        out.append((at, level))
        if level == 0 and at == 0:
            last_at = {}
        if level + s < window:
            last_at.setdefault(level + s, []).append(at)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_packing_follows_the_rule(seed):
    r = random.Random(seed)
    sizes = [r.randint(1, 20) for _ in range(80)]
    packer = packing.SumOfSquares(20)
    assert [packer.place(s) for s in sizes] == sum_of_squares(sizes, 20)


def test_packing_query_places_every_token_once(spark):
    docs = table(spark, SF, "documents")
    out = packing.pack(docs, window=512, shard_tokens=50_000).toPandas()
    tokens = {r["doc_id"]: len(r["text"].split()) for r in docs.collect()}
    assert out.groupby("doc_id")["n_tokens"].sum().to_dict() == {k: v for k, v in tokens.items() if v}
    for _, w in out.sort_values("window_start").groupby("window_id"):
        ends = (w["window_start"] + w["n_tokens"]).tolist()
        assert w["window_start"].tolist() == [0, *ends[:-1]] and ends[-1] <= 512
    closed = out.groupby("window_id")["n_tokens"].sum()
    assert closed.sum() / (len(closed) * 512) > 0.9


def test_gram_sets_in_blocks(monkeypatch):
    r = random.Random(1)
    texts = ["".join(r.choice("ab c\n\té") for _ in range(r.choice([0, 1, 3, 50, 2000]))) for _ in range(150)]
    whole = grams.gram_sets(pa.array(texts), 3)
    monkeypatch.setattr(grams, "_BLOCK_BYTES", 37)
    monkeypatch.setattr(grams, "_GROUP_TOKENS", 11)
    monkeypatch.setattr(grams, "_BLOCK", 5)
    parts = grams.gram_sets(pa.array(texts), 3)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    for i, t in enumerate(texts):
        w = t.split()
        assert whole[1][i + 1] - whole[1][i] == len({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else ())


def test_jaccard_is_exact_however_it_is_cut(spark):
    docs = table(spark, SF, "documents")
    sets = {}
    for r in docs.collect():
        w = (r["text"] or "").lower().split()
        sets[r["doc_id"]] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    ids = sorted(k for k, s in sets.items() if s)
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    for parameters in ({}, {"block_rows": 5, "bucket_grams": 3000}, {"block_chars": 4000}):
        got = jaccard.similar_pairs(docs, **parameters).collect()
        assert {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in got} == want and len(got) == len(want)
        same_classes(jaccard.classes(docs, **parameters).collect(), sets, want)


def same_classes(got, ids, pairs) -> None:
    """Rows of (id, class, links, best) are those of the components of all pairs."""
    top, links, best = {k: k for k in ids}, dict.fromkeys(ids, 0), {}

    def find(x: int) -> int:
        while top[x] != x:
            x = top[x]
        return x

    for (a, b), score in pairs.items():
        for x in (a, b):
            links[x] += 1
            best[x] = max(best.get(x, 0), score)
        a, b = sorted((find(a), find(b)))
        top[b] = a
    assert sorted(tuple(r) for r in got) == sorted((k, find(k), links[k], best.get(k)) for k in ids)


def test_a_chain_of_texts_stays_cheap_and_whole(spark):
    """One component of texts that are similar to their neighbours only, and a group of copies: no pair is lost in many blocks."""
    word = [f"w{i}" for i in range(400)]
    texts = {k: " ".join(word[5 * k : 5 * k + 30]) for k in range(70)} | {100 + k: " ".join(word[:30]) + " " * k for k in range(6)} | {200 + k: " ".join(word[40:70]) for k in range(6)}
    sets = {k: {tuple(t.split()[i : i + 3]) for i in range(28)} for k, t in texts.items()}
    ids = sorted(sets)
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    for parameters in ({"block_rows": 4}, {"block_rows": 4, "bucket_grams": 50}):
        assert {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in jaccard.similar_pairs(docs, **parameters).collect()} == want
        same_classes(jaccard.classes(docs, **parameters).collect(), ids, want)
        slim = docs.select("doc_id", "text")
        members, solid = jaccard._texts(slim)
        met = jaccard._met(solid, 3, 0.5, 4, jaccard.BLOCK_CHARS, jaccard.BUCKET_GRAMS)
        assert met.select("i", "j").distinct().count() > 10 and met.count() < 6 * solid.count()  # 19 blocks, each text in few of them


def test_jaccard_links_past_a_document_of_short_reach(spark):
    """x and z reach each other, z and y don't, x and y have exactly half of their grams in common."""
    passage, often = [f"p{i}" for i in range(22)], [f"c{i}" for i in range(4)]
    own = lambda k, n: [f"{k}own{i}" for i in range(n)]
    texts = {1: passage + own("x", 8), 2: passage + own("z", 10), 3: own("y", 8) + passage + often}
    texts |= {10 + k: often + own(f"other{k}", 30) for k in range(40)}
    got = jaccard.similar_pairs(spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id bigint, text string")).collect()
    assert {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in got} == {(1, 2): 20 / 38, (1, 3): 0.5}


@pytest.mark.parametrize("seed", range(3))
def test_links_connect_all_that_may_pair(seed):
    r = np.random.default_rng(seed)
    share = 0.5 / 1.5
    for _ in range(100):
        n, lists = int(r.integers(2, 12)), int(r.integers(1, 4))
        size = r.integers(20, 60, n)
        place = [np.sort(r.choice(n, int(r.integers(1, n + 1)), replace=False)) for _ in range(lists)]
        left = [np.array([r.integers(size[d] // 2, size[d] + 1) for d in p]) for p in place]
        frame = pd.DataFrame([{"keys": np.arange(n).tobytes(), "sizes": grams.squeeze(size.astype(np.uint32)), "place": grams.squeeze(p.astype(np.uint32)), "grams": grams.ascending(np.full(len(p), g, np.uint64)), "remaining": grams.squeeze(m.astype(np.uint32))} for g, (p, m) in enumerate(zip(place, left))])
        top = list(range(n))

        def find(k: int) -> int:
            while top[k] != k:
                k = top[k]
            return k

        for e in jaccard._links(0.5)(frame).itertuples():
            top[find(e.a)] = find(e.b)
        for p, m in zip(place, left):
            for i in range(len(p)):
                for j in range(i):
                    a, b = size[p[i]], size[p[j]]
                    if min(m[i], m[j]) >= share * (a + b) and max(a, b) <= 2 * min(a, b):
                        assert find(int(p[i])) == find(int(p[j]))


def test_fingerprints(spark):
    docs = table(spark, SF, "documents")
    prints = {r["doc_id"]: r[1:] for r in fingerprints.fingerprints(docs).collect() if len(r["signature"]) >= 7}
    runs = lambda s: {s[i : i + 7] for i in range(len(s) - 6)}
    want, ids = {}, sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            (la, x1, x2), (lb, y1, y2) = prints[a], prints[b]
            score = 100 if prints[a] == prints[b] else 0
            for x, y, level in [(x, y, p) for p, x in ((la, x1), (2 * la, x2)) for q, y in ((lb, y1), (2 * lb, y2)) if p == q]:
                if runs(x) & runs(y):
                    score = max(score, min(200 * subsequence(x, y) // (len(x) + len(y)), level // 3 * min(len(x), len(y))))
            if score >= fingerprints.MIN_SCORE:
                want[a, b] = score
    for parameters in ({}, {"bucket_entries": 500}):
        got = fingerprints.similar_fingerprints(docs, **parameters).collect()
        assert {(r["doc_a"], r["doc_b"]): r["score"] for r in got} == want and len(got) == len(want)


def test_copies_with_short_signatures(spark):
    """The query's pairs are those of the signatures and every pair of equal texts, however short or repetitive."""
    same = {1: "Oure " * 1800, 2: "Oure " * 1800, 3: "one", 4: "one", 5: "two", 6: "Oure " * 1801, 7: "one"}
    docs = spark.createDataFrame(list(same.items()), "doc_id bigint, text string")
    got = fingerprints.similar_documents(docs).collect()
    assert sorted((r["doc_a"], r["doc_b"], r["score"]) for r in got) == [(1, 2, 100), (3, 4, 100), (3, 7, 100), (4, 7, 100)]
    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["text"]}
    ids = sorted(texts)
    want = {(r["doc_a"], r["doc_b"]): r["score"] for r in fingerprints.similar_fingerprints(docs).collect()}
    more = {(a, b): 100 for i, a in enumerate(ids) for b in ids[i + 1 :] if texts[a] == texts[b]}
    got = fingerprints.similar_documents(docs).collect()
    assert {(r["doc_a"], r["doc_b"]): r["score"] for r in got} == want | more and len(got) == len(want | more) > len(want)
    same_classes(queries.op5_fingerprints(spark, SF).collect(), [r["doc_id"] for r in docs.collect()], want | more)


def test_short_near_copies(spark):
    """Short texts of invented words, some with the last, first or a middle word changed, against all pairs."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abdeghiklmnoprstu") for _ in range(r.randint(2, 9)))
    texts = {1: "Ofthonreat ernterea thtieati thlyor thount ingedre, ble.", 2: "Ofthonreat ernterea thtieati thlyor thount ingedre, the."}
    for k in range(10, 130, 2):
        w = [word() for _ in range(r.randint(6, 24))]
        texts[k] = " ".join(w)
        w[r.choice([0, len(w) // 2, -1])] = word()
        texts[k + 1] = " ".join(w)
    prints = {}
    for k, t in texts.items():
        raw = np.frombuffer(t.encode(), np.uint8)
        prints[k] = fingerprints.signatures(raw, np.array([0, len(raw)]))[0]
    runs = lambda s: {s[i : i + 7] for i in range(len(s) - 6)}
    want, ids = {}, sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            (la, x1, x2), (lb, y1, y2) = prints[a], prints[b]
            scores = [200 * subsequence(x, y) // (len(x) + len(y)) for x, y, p, q in ((x1, y1, la, lb), (x1, y2, la, 2 * lb), (x2, y1, 2 * la, lb), (x2, y2, 2 * la, 2 * lb)) if p == q and runs(x) & runs(y)]
            if max(scores, default=0) >= fingerprints.MIN_SCORE:
                want[a, b] = max(scores)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {(r["doc_a"], r["doc_b"]): r["score"] for r in fingerprints.similar_documents(docs).collect()} == want
    assert (1, 2) in want and sum(b == a + 1 for a, b in want) > 40


def entries(texts: list[str], level: int = 3) -> pa.RecordBatch:
    """Each text under each key that it shares with another, as _compare() gets them."""
    row, key = fingerprints._keys(*fingerprints._codes(texts), np.full(len(texts), level))
    frame = pd.DataFrame({"gram": (key >> np.uint64(24)).view(np.int64), "rep": row, "level": level, "text": [texts[i] for i in row]})
    frame = frame[frame.duplicated("gram", keep=False)].sort_values("gram", kind="stable")
    return pa.RecordBatch.from_pandas(frame, preserve_index=False)


def test_compare_holds_no_list_of_pairs():
    """Every pair of 2,000 signatures with one common key is found, without ever holding all two million."""
    r, letters = random.Random(3), fingerprints._LETTERS.tobytes().decode()
    batch = entries(["".join(r.choices(letters, k=50)) + "abcdefg" for _ in range(2000)])
    tracemalloc.start()
    n, largest = 0, 0
    for out in fingerprints._compare(10, False)(iter([batch.slice(k, 300) for k in range(0, len(batch), 300)])):
        n, largest = n + len(out), max(largest, len(out))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2000 * 1999 // 2 and largest <= fingerprints.PAIRS and peak < 64 << 20


def test_compare_reports_a_pair_once():
    """Signatures that share dozens of keys, in short and long lists, against all pairs."""
    r, letters = random.Random(4), fingerprints._LETTERS.tobytes().decode()
    texts = []
    for n in (90, 20, 3):
        base = "".join(r.choices(letters, k=60))
        for _ in range(n):
            t = list(base)
            for _ in range(r.randint(1, 5)):
                t[r.randrange(60)] = r.choice(letters)
            texts.append("".join(t))
    runs = [{t[i : i + 7] for i in range(len(t) - 6)} for t in texts]
    want = {}
    for i, a in enumerate(texts):
        for j in range(i):
            if runs[i] & runs[j] and (score := 200 * subsequence(a, texts[j]) // (len(a) + len(texts[j]))) >= 70:
                want[j, i] = score
    batch = entries(texts)
    for step in (7, 500, len(batch)):
        got = [x for out in fingerprints._compare(70, False)(iter([batch.slice(k, step) for k in range(0, len(batch), step)])) for x in zip(*(c.to_pylist() for c in out))]
        assert len(got) == len(want) and {(a, b): s for a, b, s in got} == want


def test_fingerprint_survives_local_edits():
    text = " ".join(f"word{random.Random(5).randint(0, 9)}{i * 7919 % 1000}" for i in range(600))
    edited = text[:2000] + " inserted " + text[2000:]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in (text, edited)]
    (la, a, _), (lb, b, _) = (fingerprints.signatures(r, np.array([0, len(r)]))[0] for r in raw)
    assert la == lb and subsequence(a, b) >= len(a) - 3


@pytest.mark.parametrize(("threshold", "shard_rows"), [(0.45, 60), (0.4, 5000)])
def test_embedding_recall(spark, threshold, shard_rows):
    v = table(spark, SF, "embeddings")
    got = neardup.near_duplicates(v, threshold=threshold, shard_rows=shard_rows).toPandas()
    f = v.toPandas()
    x = np.stack(f["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
    ids = f["vec_id"].to_numpy()
    want = {(min(ids[a], ids[b]), max(ids[a], ids[b])) for a, b in zip(i, j)}
    found = set(zip(got["vec_a"], got["vec_b"]))
    assert not found - want and len(found) >= 0.98 * len(want) and len(want) > 5


@pytest.mark.parametrize("shard_rows", [100, 5000])
def test_embedding_classes_at_the_registered_threshold(spark, shard_rows):
    """Planted copies and near copies, compared with all pairs; the audit lets nothing pass below its target."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 24))
    x[100:160] = x[:60] + 0.04 * rng.normal(size=(60, 24))
    x[160:200] = x[7] + 0.03 * rng.normal(size=(40, 24))
    x[200:220] = x[9]
    x = x.astype(np.float32)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = unit @ unit.T
    want = {(int(a), int(b)): round(float(s[a, b]), 4) for a, b in zip(*np.nonzero(np.triu(s >= neardup.THRESHOLD, 1)))}
    got = [(*r[:3], r[3] if r[3] is None else round(r[3], 4)) for r in neardup.near_duplicate_classes(docs, shard_rows=shard_rows, recall=1.0, audit=400).collect()]
    same_classes(got, range(400), want)


def test_audit_is_null_without_pairs_and_raises_below_its_target(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rare = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.eye(6)[:3])] + [(9, [1.0] + [0.0] * 5)], "vec_id bigint, embedding array<float>")
    assert [r["audited_recall"] for r in neardup.near_duplicates(rare).collect()] == [None]
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))], "vec_id bigint, embedding array<float>")
    monkeypatch.setattr(neardup, "search_graph", lambda *a: spark.createDataFrame([], neardup.PAIRS))
    with pytest.raises(RuntimeError, match="recall"):
        neardup.near_duplicates(data, threshold=0.9, shard_rows=50)
    assert {r["audited_recall"] for r in neardup.near_duplicates(data, threshold=0.9, shard_rows=5000).collect()} == {1.0}


def test_graph_search_finds_groups():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(600, 16)), *(rng.normal(size=(1, 16)) + 0.02 * rng.normal(size=(m, 16)) for m in [200] + [3] * 40)])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)[rng.permutation(len(x))]
    s = x @ x.T
    np.fill_diagonal(s, -1)
    want = set(zip(*map(list, np.nonzero(s >= 0.97))))
    got = {(a, b) for q, n in neardup.range_search(x, neardup.shard_graph(x), np.array([neardup.medoid(x)]), np.arange(len(x)), 0.97) for a, b in zip(q.tolist(), n.tolist())}
    assert got <= want and len(got) >= 0.98 * len(want)


def test_hot_clusters_are_cut_without_loss(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=8)
    data = [(i, (base + 0.01 * rng.normal(size=8)).tolist()) for i in range(120)]
    got = neardup.near_duplicates(spark.createDataFrame(data, "vec_id bigint, embedding array<float>"), threshold=0.99, shard_rows=10)
    assert got.count() >= 0.98 * 120 * 119 / 2


def test_pages_against_plain_dynamic_programming():
    r = random.Random(3)
    for _ in range(400):
        a, b = ([r.choice("abcdef") for _ in range(r.randint(0, 25))] for _ in range(2))
        kept = pages.shared_lines(a, b)
        assert len(kept) == subsequence(a, b) == subsequence([a[i] for i in kept], b) and kept == sorted(set(kept))


def test_page_query(spark):
    rows = table(spark, SF, "pages").toPandas()
    out = pages.own_text(table(spark, SF, "pages")).toPandas().set_index("page_id")
    lines = {r.page_id: pages.lines_of(r.html) for r in rows.itertuples()}
    # the partner, by brute force: the neighbour with the longer common path in the order of host, path, url and id
    part = {r.page_id: re.match(r"[a-zA-Z]+://([^/]+)([^?#]*)", r.url or "") for r in rows.itertuples()}
    url = {r.page_id: r.url for r in rows.itertuples()}
    order = sorted((m[1].lower(), m[2], url[k], k) for k, m in part.items() if m)
    for i, (host, path, _, k) in enumerate(order):
        near = [(len(os.path.commonprefix([path, o[1]])), -at, o[3]) for at, o in enumerate((order[i - 1] if i else ("",) * 4, order[i + 1] if i + 1 < len(order) else ("",) * 4)) if o[0] == host]
        assert (max(near)[2] if near else None) == (None if pd.isna(out.loc[k, "partner_id"]) else out.loc[k, "partner_id"])
    assert sorted(out.index) == sorted(lines)
    for k, r in out.iterrows():
        shared = 0 if r["partner_id"] != r["partner_id"] else subsequence(lines[k], lines[int(r["partner_id"])])
        assert (r["n_lines"], r["n_shared"]) == (len(lines[k]), shared) and len([x for x in r["text"].split("\n") if x]) == len(lines[k]) - shared


def test_deobfuscation_and_scores(spark):
    r = random.Random(9)
    plain, rude = "the quiet garden path leads to old mill good day reading by river walking home talking rain bread winter letter market yellow stone".split(), "idiot loser stupid clown pathetic trash".split()
    made = lambda: "".join(r.choice("bdglmnrst") + r.choice("aeiou") for _ in range(3))
    data = [(i, " ".join(r.sample(plain, 8) + [made() for _ in range(6)] + (r.sample(rude, 3) if i >= 90 else []))) for i in range(180)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, int(i >= 90)) for i in range(180)], "doc_id bigint, quality int, toxic int")
    hidden = ["you 1d10t", "an i d i o t indeed", "what a l.o.s.e.r", "so st00pid st*pid", "loooooser!!", "$tup1d", "p4thet1c", "the quiet old mill", "walking home by the river", None, ""]
    probe = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(hidden)], "doc_id bigint, text string")
    scored = toxicity.toxicity(docs.unionByName(probe), labels).toPandas().set_index("doc_id")
    assert [bool(scored.loc[1000 + i, "is_toxic"]) for i in range(len(hidden))] == [True] * 7 + [False] * 4
    assert scored.loc[range(90), "is_toxic"].sum() == 0 and scored.loc[range(90, 180), "is_toxic"].all()


def test_spaced_words():
    counts = np.zeros(toxicity.SYMBOLS**4, np.int64)
    for w in ("idiot", "loser", "stupid", "ass", "you"):
        counts += 50 * toxicity.gram_counts(toxicity.symbols(np.frombuffer(f"{w} ".encode(), np.uint8)))
    restorer = toxicity.Restorer(toxicity.log_model(counts))
    for text, word in [
        ("you i d i o t.", "idiot"), ("you l o s e r!", "loser"), ("you $ t u p 1 d", "stupid"), ("you @ s s", "ass"), ("i  d  i  o  t", "idiot"), ("i\nd\ni\no\nt", "idiot"), ("(l o s e r)", "loser"), ("\"i d i o t\", you", "idiot"),
        ("i d i o t?! you", "idiot"), ("an i d i o t indeed", "idiot"), ("l 0 s 3 r", "loser"), ("l o s e r, i d i o t.", "loser"), ("l o s e r, i d i o t.", "idiot"),
    ]:
        assert word in toxicity.words_of(text, restorer)[0], text
    for text in ("* * *", "| | | |", "+ + +", "you * * * you"):
        assert toxicity.words_of(text, restorer) == ({"you"} if "you" in text else set(), 0), text


def test_decoding_is_the_best_path():
    counts = np.zeros(toxicity.SYMBOLS**4, np.int64)
    for w in ("idiot", "ideal", "loser", "lasso", "stupid"):
        counts += toxicity.gram_counts(toxicity.symbols(np.frombuffer(f"{w} ".encode(), np.uint8)))
    model = toxicity.log_model(counts)
    for token in ("1d10t", "l0s3r", "la$$0", "s+up1d", "id3al"):
        options = [""]
        paths = [("", 0.0)]
        for column in toxicity.lattice(token):
            paths = [(p + x, c + k) for p, c in paths for x, k in column]
        del options

        def cost(word: str) -> float:
            h, total = 0, 0.0
            for c in word + " ":
                k = 0 if c == " " else ord(c) - 96
                total += float(model[h * toxicity.SYMBOLS + k])
                h = h * toxicity.SYMBOLS % toxicity.SYMBOLS**3 + k if k else 0
            return total

        best = max(paths, key=lambda p: cost(p[0]) - p[1])
        assert toxicity.decode(token, model) == best[0].strip()


def test_decoding_keeps_every_state():
    """Heavily masked tokens against exhaustive search, by the score of the path."""
    counts = np.zeros(toxicity.SYMBOLS**4, np.int64)
    often = [f"{x}b{y}s" for x in "aeiou" for y in "aeiou" if x + y != "uu"]  # 24 beginnings that are likelier than the right one of *b*k
    for w, n in [("idiot", 9), ("loser", 9), ("stupid", 9), ("ubuk", 3), *[(w, 100) for w in often]]:
        counts += n * toxicity.gram_counts(toxicity.symbols(np.frombuffer(f"{w} ".encode(), np.uint8)))
    model = toxicity.log_model(counts)

    def cost(word: str) -> float:
        h, total = 0, 0.0
        for c in word + " ":
            k = toxicity.symbol_of(c) if c != " " else 0
            total += float(model[h * toxicity.SYMBOLS + k])
            h = h * toxicity.SYMBOLS % toxicity.SYMBOLS**3 + k if k else 0
        return total

    for token in ("s*+*p!d", "1*6!", "*1*6*", "!6*1|*", "6*!1*5", "*b*k", "*8*k", "*6*k"):
        paths = [("", 0.0)]
        for column in toxicity.lattice(token):
            paths = [(p + x, c + k) for p, c in paths for x, k in column]
        best = max(paths, key=lambda p: cost(p[0]) - p[1])
        assert toxicity.decode(token, model) == best[0].strip(), token
    assert toxicity.decode("*b*k", model) == "ubuk"


def test_quality_on_held_out_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    train, held = labels.filter("doc_id % 3 <> 0"), labels.filter("doc_id % 3 = 0").toPandas().set_index("doc_id")
    scored = quality.quality_scores(docs, train).toPandas().set_index("doc_id").join(held, how="inner")
    good, bad = scored[scored["quality"] == 1], scored[scored["quality"] == 0]
    assert good["is_good"].mean() > 0.97 and bad["is_good"].mean() < 0.35


def test_quality_difference_is_the_summed_pieces():
    both = quality.Compressors(b"good words here " * 50, b"bad words there " * 50)
    raw = b"some good words and more " * 400
    parts = [raw[i : i + quality.PIECE] for i in range(0, len(raw), quality.PIECE)]
    bad, good = both.sides
    assert both.difference(raw) == sum(len(bad.compress(p)) - len(good.compress(p)) for p in parts) / len(raw)


def test_warc_streams(spark, tmp_path):
    payloads = [b"", b"x" * 100_000, bytes(range(256)) * 300]
    raw = b"".join(warc.warc_record(f"urn:uuid:{i}", f"http://h/{i}", p) for i, p in enumerate(payloads))
    members = b"".join(gzip.compress(warc.warc_record(f"urn:uuid:{i}", f"http://h/{i}", p)) for i, p in enumerate(payloads))
    for name, data in (("a.warc", raw), ("b.warc.gz", gzip.compress(raw)), ("c.warc.gz", members)):
        (tmp_path / name).write_bytes(data)
        out = warc.read_warc(spark, [str(tmp_path / name)], chunk_bytes=5000).toPandas().sort_values(["record_id", "chunk_no"])
        assert [b"".join(g["payload"]) for _, g in out.groupby("record_id")] == payloads
    assert max(len(r[9]) for r in warc.warc_chunks(warc.ByteStream(io.BytesIO(raw).read, 1 << 12), 5000)) <= 5000


def test_damaged_archives_give_error_rows(spark, tmp_path):
    """Junk, bad lengths, endless lines, cut records and damaged gzip members: all good records survive, each fault has its row."""
    good = lambda i, n=50: warc.warc_record(f"urn:{i}", f"http://h/{i}", bytes([65 + i]) * n)
    head = b"WARC/1.1\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: "
    cases = {
        "junk": (good(0) + b"some junk\r\nmore junk\r\n" + good(1), [0, 1], ["not a record"]),
        "letters": (good(0) + head + b"ten\r\n\r\nbody of it\r\n\r\n" + good(1), [0, 1], ["bad length"]),
        "negative": (good(0) + head + b"-5\r\n\r\nbody\r\n\r\n" + good(1), [0, 1], ["bad length"]),
        "no newline": (good(0) + b"x" * 300_000 + b"\n" + good(1), [0, 1], ["not a record"]),
        "no end": (good(0) + head + b"5\r\n" + good(1), [0, 1], ["not a record"]),
        "cut": (good(0) + good(1)[:-30], [0], ["truncated"]),
        "cut head": (good(0) + b"WARC/1.1\r\nContent-Le", [0], []),
        "only junk": (b"\x00\xff" * 5000, [], ["not a record"]),
        "empty": (b"", [], []),
    }
    members = [gzip.compress(good(i, 4000 + i)) for i in range(3)]
    broken = bytearray(members[1])
    broken[len(broken) // 2] ^= 0xFF
    broken[-8:-4] = b"\0\0\0\0"
    cases["member"] = members[0] + bytes(broken) + members[2], [0, 2], ["damaged gzip"]
    cases["cut member"] = members[0] + members[1][:-20], [0], ["truncated"]
    for name, (data, want, errors) in cases.items():
        path = tmp_path / name
        path.write_bytes(data)
        for block in (1 << 18, 64):
            got = list(warc.warc_chunks(warc.ByteStream(io.BytesIO(data).read, block), 1000))
            whole = {r[0] for r in got if r[6] and r[0] != "urn:x"}
            assert {f"urn:{i}" for i in want} <= whole, (name, block, [r[0:7] + r[-1:] for r in got])
            seen = [r[-1] for r in got if r[-1]]
            assert all(any(x.startswith(e) for x in seen) for e in errors) and len(seen) <= len(errors) + 1, (name, block, seen)
    out = warc.read_warc(spark, [str(tmp_path / n) for n in cases])
    assert out.filter("error IS NOT NULL").count() >= 9 and out.filter("is_last AND error IS NULL").select("record_id").distinct().count() == 3


def test_chunks_follow_one_another_over_batches(spark):
    """Records of many chunks, in Arrow batches of three rows: running digests and bytes as if each record were hashed alone."""
    import hashlib

    data = [(i, f"u{i}", "é" * (700 * i)) for i in range(9)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = warc.chunk_pages(spark.createDataFrame(data, "page_id bigint, url string, html string"), chunk_bytes=501).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i, _, text in data:
        rows = got[got["page_id"] == i].sort_values("chunk_no")
        raw, n = text.encode(), 0
        for r in rows.itertuples():
            n += len(r.payload)
            assert r.running_digest == hashlib.sha256(raw[:n]).hexdigest() and r.chunk_digest == hashlib.sha256(r.payload).hexdigest() and r.is_last == (n == len(raw))
        assert b"".join(rows["payload"]) == raw


def test_contradictory_labels_are_left_out(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id bigint, text string")
    rows = [(i, q, 0) for i in range(40) for q in ((0, 1) if i < 20 else (i % 2,))]
    for order in (rows, rows[::-1]):
        labels = spark.createDataFrame(order + order[:5] + [(99, 1, 0), (None, 1, 1), (30, None, None)], "doc_id bigint, quality int, toxic int")
        got = quality.labelled_sample(docs, labels, 1000).collect()
        assert sorted((r["doc_id"], r["class"]) for r in got) == [(i, i % 2) for i in range(20, 40)]


def test_toxicity_on_held_out_labels(spark):
    """Labels of two thirds of the ids are learnt from; of the others, English toxic documents are found and clean ones left alone."""
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    held = labels.filter("doc_id % 3 = 0").toPandas().set_index("doc_id")
    scored = toxicity.toxicity(docs, labels.filter("doc_id % 3 <> 0")).toPandas().set_index("doc_id").join(held, how="inner")
    lang = docs.select("doc_id", "lang").toPandas().set_index("doc_id")
    scored = scored.join(lang)
    found = scored[scored["toxic"] == 1].groupby("lang")["is_toxic"].mean()
    print(found, scored[scored["toxic"] == 0]["is_toxic"].mean())
    assert found["en"] > 0.9 and scored[scored["toxic"] == 1]["is_toxic"].mean() > 0.85 and scored[scored["toxic"] == 0]["is_toxic"].mean() < 0.02


def test_quality_scores_are_calibrated(spark):
    """Held-out documents of a score band are good about as often as the band says, weighted by the documents in it."""
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    scored = quality.quality_scores(docs, labels.filter("doc_id % 3 <> 0")).toPandas().set_index("doc_id").join(labels.filter("doc_id % 3 = 0").toPandas().set_index("doc_id"), how="inner")
    band = scored.groupby((scored["score"] * 10).astype(int).clip(0, 9))[["score", "quality"]].agg(["mean", "size"])
    gap = (abs(band["score"]["mean"] - band["quality"]["mean"]) * band["score"]["size"]).sum() / len(scored)
    print(gap, scored.groupby("quality")["is_good"].mean())
    assert gap < 0.05 and scored[scored["quality"] == 1]["is_good"].mean() > 0.97 and scored[scored["quality"] == 0]["is_good"].mean() < 0.1


def test_character_counts_don_t_cut_words(spark, monkeypatch):
    docs = spark.createDataFrame([("héllo wörld " * 50,), ("x" * 300,), ("ein, zwei-drei",)], "text string")
    whole = toxicity.corpus_counts(docs)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    raw = np.frombuffer(("héllo wörld " * 50 + "x" * 300 + " ein, zwei-drei ").encode(), np.uint8)
    total, a = np.zeros(toxicity.SYMBOLS**4, np.int64), 0
    while a < len(raw):
        b = toxicity.block_end(raw, a + toxicity.BLOCK)
        total += toxicity.gram_counts(toxicity.symbols(raw[a:b]))
        a = b
    body = toxicity.SYMBOLS * np.arange(toxicity.SYMBOLS**3)
    keep = np.ones(len(total), bool)
    keep[body] = False  # word ends; a block that ends at a boundary counts it twice
    assert (total[keep] == whole[keep]).all()


def test_pipeline_against_its_operators(spark):
    """Each stage keeps exactly the rows that its operator's full result calls for."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(corpus_pipeline.shared_table(stage(spark, frames[-1], SF), name))
    ids = [sorted(r["doc_id"] for r in f.collect()) for f in frames]
    good = {r["doc_id"] for r in quality.quality_scores(docs, labels).collect() if r["is_good"]}
    assert ids[1] == sorted(good)
    assert ids[2] == sorted(r["doc_id"] for r in toxicity.toxicity(frames[1], labels).collect() if not r["is_toxic"])
    parent = {i: i for i in ids[2]}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for r in jaccard.similar_pairs(frames[2]).collect():
        a, b = sorted((find(r["doc_a"]), find(r["doc_b"])))
        parent[b] = a
    assert ids[3] == sorted(i for i in ids[2] if find(i) == i)
    assert ids[4] == sorted(r["doc_id"] for r in mixing.mix(frames[3]).collect())
    tokens = sum(len(r["text"].split()) for r in frames[4].collect())
    assert sum(r["n_tokens"] for r in frames[5].collect()) == tokens > 0
    assert corpus_pipeline.run(spark, SF).count() == len(ids[5])


def test_every_operator_has_a_query():
    names = queries.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_squeezed_arrays_return_empty_ones_included():
    from factloom.llm.grams import ascending, from_ascending, squeeze, unsqueeze

    for kind in (np.uint8, np.uint32, np.uint64):
        for a in (np.zeros(0, kind), np.arange(5, dtype=kind)):
            assert unsqueeze(squeeze(a), kind).tolist() == from_ascending(ascending(a), kind).tolist() == a.tolist()
