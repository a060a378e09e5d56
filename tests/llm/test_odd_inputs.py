"""Every operator on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import pytest

from airsleuth.llm.decontaminate import drop_contaminated, find_items
from airsleuth.llm.fingerprints import fingerprint_documents
from airsleuth.llm.language_model import score_documents
from airsleuth.llm.licenses import scan_licenses
from airsleuth.llm.line_dedup import drop_boilerplate
from airsleuth.llm.near_dedup import drop_near_duplicates, near_duplicates
from airsleuth.llm.packing import pack
from airsleuth.llm.quality import co_train, score_quality
from airsleuth.llm.tables import freeing
from airsleuth.llm.token_files import read_token_files, write_token_files
from airsleuth.llm.url_filter import judge
from airsleuth.session import scratch_path


@pytest.fixture(autouse=True)
def clean():
    with freeing():
        yield


@pytest.fixture
def items(spark):
    return spark.createDataFrame(
        [(1, "alpha beta gamma delta epsilon", "z"), (1, "alpha beta gamma delta epsilon", "z"), (2, None, "z"), (3, "", "z"),
         (4, "one", None), (None, "words of a page without an", "z")], "item_id long, text string, doc_id string")


def test_decontamination(odd_documents, items):
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.n_words) for r in find_items(odd_documents, items).collect()}
    assert got == {(1, 1): (1.0, 0, 5), (5, 4): (1.0, 0, 1), (None, None): (1.0, 1, 6)}
    left = [r.doc_id for r in drop_contaminated(odd_documents, items).collect()]
    assert sorted(left) == [2, 3, 4, 6, 7, 8]
    assert find_items(odd_documents, items.limit(0)).count() == 0 and find_items(odd_documents.limit(0), items).count() == 0


def test_licenses(odd_documents):
    found = scan_licenses(odd_documents).collect()
    rows = {r.doc_id: r for r in found}
    assert len(found) == 10 and len(rows) == 9 and rows[2].n_words == 0 and rows[7].n_words == 30000 and rows[1].n_base == 0
    assert all(r.labels == "" and r.base_labels == "" and r.first_word is None and r.score == 0.0 for r in rows.values())
    assert scan_licenses(odd_documents.limit(0)).count() == 0


def test_near_duplicates(odd_documents):
    rows = near_duplicates(odd_documents).collect()
    assert len(rows) == 10 and all(r.kept == (r.doc_id == r.component_id) for r in rows if r.doc_id is not None)
    assert {r.n_shingles for r in rows if r.doc_id in (2, 3, 4)} == {0} and {r.n_shingles for r in rows if r.doc_id == 7} == {1}
    kept = drop_near_duplicates(odd_documents)
    assert kept.columns == odd_documents.columns and kept.filter("doc_id = 1").count() == 1 and kept.count() == 9
    assert near_duplicates(odd_documents.limit(0)).count() == 0


def test_unlinked_texts_stay_whatever_their_ids(spark, prose):
    """Unlike texts without an id or under one repeated id are no group; copies still are."""
    none, twice, first = [prose(i, 40) for i in (1, 2)], [prose(i, 40) for i in (3, 4)], prose(5, 40)
    rows = [*((None, t) for t in none), *((7, t) for t in twice), (None, none[0]), (7, twice[1]), (None, first), (2, first), (9, first + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(str, drop_near_duplicates(docs).collect())) == sorted(
        map(str, spark.createDataFrame([*rows[:4], (2, first)], docs.schema).collect()))
    found = near_duplicates(docs).select("label", "content").distinct()
    assert found.select("label").distinct().count() == 5 and found.count() == 6


def test_language_model(odd_documents):
    rows = score_documents(odd_documents).collect()
    assert len(rows) == 10 and all(r.score < 0 and r.base_score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1} and not any(r.held_out for r in rows if r.doc_id is None)
    assert score_documents(odd_documents.limit(0)).count() == 0


def test_quality(spark, odd_documents):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1), (8, None), (99, 1)], "doc_id long, quality int")
    scored = score_quality(odd_documents, co_train(odd_documents, labels))
    assert scored.count() == 10 and scored.filter("quality_score is null").count() == 0
    assert set(odd_documents.columns) < set(scored.columns)
    unlabelled = score_quality(odd_documents, co_train(odd_documents, labels.limit(0)))
    assert unlabelled.filter("good").count() == 10
    assert score_quality(odd_documents.limit(0), co_train(odd_documents.limit(0), labels)).count() == 0


def test_packing(odd_documents):
    rows = pack(odd_documents).toPandas()
    assert rows.groupby("sequence_id")["length"].sum().max() <= 2048
    assert sorted(rows[rows["start"] == 0].groupby("doc_id", dropna=False).size()) == [1] * 8 + [2]
    assert pack(odd_documents.limit(0)).count() == 0


def test_fingerprints(odd_documents):
    rows = fingerprint_documents(odd_documents).collect()
    assert len(rows) == 10 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert len({tuple(r.anchors) for r in rows if r.doc_id == 1}) == 1 and {tuple(r.anchors) for r in rows if r.doc_id in (2, 3)} == {()}
    assert fingerprint_documents(odd_documents.limit(0)).count() == 0


def test_line_dedup(odd_documents):
    rows = drop_boilerplate(odd_documents, ratio=0.1, min_pages=2, sigmas=0.0)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in rows.collect()}
    assert rows.count() == 10 and got[1] == (1, 1, "") and got[2] == (1, 0, "") and got[4] == (2, 0, " \n\t ")
    assert drop_boilerplate(odd_documents.limit(0)).count() == 0


def test_token_files(spark, odd_documents):
    manifest = write_token_files(odd_documents, scratch_path(spark, "ids"), parts=3)
    rows = read_token_files(spark, manifest).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8] and rows[3].n_tokens == 1
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))
    assert read_token_files(spark, write_token_files(odd_documents.limit(0), scratch_path(spark, "ids"))).count() == 0


def test_url_filter(spark):
    pages = spark.createDataFrame([
        (1, None, "k"), (2, "", "k"), (3, "no scheme", "k"), (4, "http://", "k"), (4, "http://", "k"), (5, "https://A.Example.ORG/es/x?q", "k"),
        (None, "x://com/de/", "k"), (6, "ftp://notcom/de/", "k"), (7, "http://b.net?x/y", "k")], "page_id long, url string, key string")
    listed = spark.createDataFrame([("b.net",), (None,), ("b.net",), ("elsewhere",)], "key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(pages, listed).collect()}
    assert got == {
        1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"),
        5: ("a.example.org", "/es/x", "example.org/es/", "block"), None: ("com", "/de/", "com/de/", "block"),
        6: ("notcom", "/de/", None, "allow"), 7: ("b.net", "", None, "block")}
    assert judge(pages.limit(0), listed).count() == 0 and judge(pages, listed.limit(0)).filter("verdict = 'block'").count() == 2
