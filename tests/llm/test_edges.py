"""Defined results of every operator and pipeline stage for awkward tables."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

import corpus_pipeline
from factloom.llm import chat, fingerprints, jaccard, mixing, neardup, packing, pages, quality, toxicity, warc
from factloom.storage import shared_dir
from tests.llm import cases
from tests.session import rows

DOC_OPERATORS = {
    "packing": lambda d, lab: packing.pack(d), "fingerprints": lambda d, lab: fingerprints.similar_fingerprints(d), "prints": lambda d, lab: fingerprints.fingerprints(d), "jaccard": lambda d, lab: jaccard.similar_pairs(d), "jaccard_classes": lambda d, lab: jaccard.classes(d), "print_classes": lambda d, lab: fingerprints.similar_classes(d),
    "mixing": lambda d, lab: mixing.mix(d), "quality": quality.quality_scores, "toxicity": toxicity.toxicity,
    "keep_good": quality.keep_good, "keep_clean": toxicity.keep_clean, "keep_one": lambda d, lab: jaccard.keep_one(d), "select_mix": lambda d, lab: mixing.select_mix(d),
}
KEEPS_COLUMNS = {"keep_good", "keep_clean", "keep_one", "select_mix"}


@pytest.mark.parametrize("name", DOC_OPERATORS)
def test_document_operators(spark, name):
    run, docs, labels = DOC_OPERATORS[name], cases.docs(spark), cases.labels(spark)
    plain = run(docs, labels).toPandas()
    more = run(cases.clashing(docs), cases.clashing(labels)).toPandas()
    if name in KEEPS_COLUMNS:
        assert set(docs.columns) <= set(more.columns)
        more = more[docs.columns]
    assert rows(plain) == rows(more)
    assert not len(run(docs.limit(0), labels).toPandas())
    assert not len(run(docs.limit(0), labels.limit(0)).toPandas())
    run(docs, labels.limit(0)).count()
    ids = [None if x != x else int(x) for x in plain["doc_id"]] if "doc_id" in plain else []
    if name in ("quality", "toxicity"):
        assert len(plain) == docs.count() and ids.count(6) == 2 and ids.count(None) == 2
    if name == "keep_good":
        assert not {2, 3, 4} & set(ids)
    if name == "keep_clean":
        assert {2, 3, 4} <= set(ids)
    if name in ("packing", "select_mix"):
        assert not {2, 3, 4} & set(ids)
    if name == "packing":
        assert plain[plain["doc_id"] == 5]["n_tokens"].sum() == 60_000 and ids.count(6) == 2 and None in ids
    if name == "jaccard":
        pairs = set(zip(plain["doc_a"], plain["doc_b"]))
        assert pairs == {(1, 6), (1, 7), (6, 7), (5, 10)} and dict(zip(zip(plain["doc_a"], plain["doc_b"]), plain["jaccard"]))[1, 6] == 1
    if name == "jaccard_classes":
        got = {(int(r.doc_id), int(r.class_id), int(r.n_links), None if r.best_jaccard != r.best_jaccard else r.best_jaccard == 1) for r in plain.itertuples()}
        assert got == {(1, 1, 2, True), (6, 1, 2, True), (7, 1, 2, False), (5, 5, 1, False), (10, 5, 1, False), *((k, k, 0, None) for k in (2, 3, 4, 8, 9, 11))} and len(plain) == 11
    if name == "print_classes":
        got = {int(r.doc_id): (int(r.class_id), int(r.n_links)) for r in plain.itertuples()}
        assert sorted(got) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11] and len(plain) == 11 and got[6][0] == 1 and got[10][0] == 5 and all(got[k] == (k, 0) for k in (2, 3, 4, 8, 9))
    if name == "keep_one":
        assert sorted(x for x in ids if x) == [1, 2, 3, 4, 5, 8, 9, 11] and ids.count(None) == 2
    if name == "fingerprints":
        assert {(1, 6), (5, 10)} <= set(zip(plain["doc_a"], plain["doc_b"])) and all(a < b for a, b in zip(plain["doc_a"], plain["doc_b"]))
    if name == "prints":
        assert not {2, 3} & set(ids) and {1, 4, 5, 8} <= set(ids)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_pipeline_stages(spark, stage, tmp_path):
    docs, labels = cases.docs(spark), cases.labels(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = stage[1](spark, docs, str(tmp_path))
    if stage[0] != "packing":
        assert out.columns == docs.columns
    more = stage[1](spark, cases.clashing(docs), str(tmp_path))
    assert rows(out.toPandas()) == rows(more.select(out.columns).toPandas())
    assert stage[1](spark, docs.limit(0), str(tmp_path)).isEmpty()


def test_pipeline_runs_over_awkward_tables(spark, tmp_path):
    cases.docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    cases.labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    assert set(corpus_pipeline.run(spark, str(tmp_path)).columns) == {"doc_id", "piece", "window_id", "window_start", "doc_start", "n_tokens"}


def test_pages(spark):
    menu = "<ul><li>Home</li><li>About</li></ul>"
    data = [
        (1, "http://h.example/a/1", f"<html>{menu}<p>first text</p></html>"), (2, "http://H.example/a/2?x=1", f"<html>{menu}<p>second text</p><p>first text</p></html>"), (3, None, menu), (4, "http://h.example/b", None),
        (5, "http://alone.example/", f"{menu}<p>x &amp; y</p>"), (None, "", "<p>no url</p>"), (1, "http://h.example/a/1", f"<html>{menu}<p>first text</p></html>"), (6, "not a url", "<script>no</script>text"), (7, "http://h.example/a/3", "<div>" * 5000 + "deep" + "\n".join(f"<p>line {i}</p>" for i in range(3000))), (8, "http://h.example/a/1", "<p>first text</p>"),
    ]
    table = spark.createDataFrame(data, "page_id bigint, url string, html string")
    out = pages.own_text(table).toPandas()
    assert rows(out) == rows(pages.own_text(cases.clashing(table)).toPandas()) == rows(pages.own_text(table, ranges=1).toPandas())
    by = {None if r.page_id != r.page_id else int(r.page_id): r for r in out.itertuples()}
    assert len(out) == 9 and by[5].text == "Home\nAbout\nx & y" and by[5].partner_id != by[5].partner_id
    assert by[3].partner_id != by[3].partner_id and by[4].n_lines == 0 and by[None].text == "no url" and by[6].text == "text"
    assert by[8].partner_id == 1 and by[8].text == "" and by[1].text == "Home\nAbout" and by[2].text == "second text\nfirst text" or by[2].n_shared >= 1
    assert pages.own_text(table.limit(0)).isEmpty()


def test_pages_keep_no_text(spark):
    """What is kept of pages between the stages has hashes of their lines, not their text."""
    r = random.Random(2)
    data = [(k, f"http://h.example/a/{k}", "".join(f"<p>{r.getrandbits(4096):x}</p>" for _ in range(8))) for k in range(200)]
    table = spark.createDataFrame(data, "page_id bigint, url string, html string")
    at = Path(shared_dir(spark).removeprefix("file://"))
    size = lambda: sum(p.stat().st_size for p in at.rglob("*.parquet"))
    before = size()
    out = pages.own_text(table)
    assert out.count() == 200 and size() - before < 0.25 * sum(len(d[2]) for d in data)


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.99, 0.01, 0.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [nan, 1.0, 0.0]), (8, [inf, 1.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (10, [0.0, 1.0, 0.0]), (1, [1.0, 0.0, 0.0]), (11, [None, 1.0, 0.0]),
    ]
    table = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    out = neardup.near_duplicates(table).toPandas()
    assert set(zip(out["vec_a"], out["vec_b"])) == {(1, 2), (1, 3), (2, 3)} and (out["audited_recall"] == 1).all()
    classed = neardup.near_duplicate_classes(table).toPandas()
    assert {(r.vec_id, r.class_id, r.n_links) for r in classed.itertuples()} == {(1, 1, 2), (2, 1, 2), (3, 1, 2), *((k, k, 0) for k in range(4, 12))} and len(classed) == 11
    assert rows(classed) == rows(neardup.near_duplicate_classes(cases.clashing(table)).toPandas()) and neardup.near_duplicate_classes(table.limit(0)).isEmpty()
    assert rows(out) == rows(neardup.near_duplicates(cases.clashing(table)).toPandas())
    assert neardup.near_duplicates(table.limit(0)).isEmpty() and neardup.near_duplicates(table.filter("vec_id = 1")).isEmpty()


def test_chat_and_warc(spark):
    talk = spark.createDataFrame([(1, 0, "ann", "hi"), (1, 1, None, None), (1, 1, None, None), (None, None, "bob", "x <|im_end|> y"), (2, 0, "system", "only rules"), (1, 2, "a\nb", "z" * 300_000)], "conv_id bigint, turn bigint, role string, text string")
    out = chat.rotate_perspectives(talk).toPandas()
    assert len(out) == 4 and rows(out) == rows(chat.rotate_perspectives(cases.clashing(talk)).toPandas())
    assert not out["rendered"].str.contains("x <|im_end|>", regex=False).any() and chat.rotate_perspectives(talk.limit(0)).isEmpty()
    page = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "v", "é" * 20_000), (1, "u", None)], "page_id bigint, url string, html string")
    chunks = warc.chunk_pages(page).toPandas()
    assert len(chunks) == 3 + 3 and rows(chunks) == rows(warc.chunk_pages(cases.clashing(page)).toPandas())
    assert warc.chunk_pages(page.limit(0)).isEmpty() and warc.broken_records(warc.chunk_pages(page)).isEmpty()
