"""License spans that stand in the text or only seem to, and the base phrases by brute force."""

from __future__ import annotations

import re

from airsleuth.llm.licenses import NOTICES, PHRASES, TEXTS, plain_words, scan_licenses
from airsleuth.llm.queries import QUERIES
from tests.conftest import SF

GPL = max((text for label, text in NOTICES if label == "gpl-3"), key=len).split()


def _scan(spark, texts):
    rows = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: r for r in rows}


def test_scattered_words_are_no_notice(spark):
    """Five words of the notice, two others, and so on: all of the runs stand there, the notice does not."""
    scattered = " ".join(" ".join(GPL[i:i + 5]) + f" foreign{i} words{i}" for i in range(0, len(GPL), 5))
    halves = " ".join(GPL[16:] + GPL[:16])
    edited = GPL[:10] + ["very"] + GPL[10:20] + GPL[21:]
    found = _scan(spark, [scattered, halves, " ".join(GPL), "before " * 50 + " ".join(edited) + " after" * 50])
    assert found[0].labels == "" and found[0].score == 0.0 and found[0].spans == []
    assert found[1].labels == "" and found[2].labels == "gpl-3" and found[2].score == 1.0
    assert found[3].labels == "gpl-3" and 0.7 <= found[3].score < 1
    assert [(s.first_word, s.last_word) for s in found[3].spans] == [(50, 49 + len(edited))]


def test_spans_are_no_longer_than_template_and_drift(spark):
    many = " ".join(GPL + GPL[:8] + GPL + ["x"] * 3 + GPL)
    spans = _scan(spark, [many])[0].spans
    assert len(spans) == 3 and all(s.last_word - s.first_word < 1.2 * len(GPL) for s in spans)


def test_whole_license_texts_with_edits(spark):
    """Every 40th word lost, a holder's name put in; halves in the wrong order are no text."""
    rows = []
    for label, text in TEXTS:
        plain = plain_words(text)
        edited = [w for i, w in enumerate(plain) if i % 40 != 39]
        rows.append(" ".join(["Copyright", "X", *edited[:60], "Example", "Corp", *edited[60:], "end"]))
    found = _scan(spark, rows)
    for i, (label, text) in enumerate(TEXTS):
        size = len(plain_words(text))
        assert label in found[i].labels.split(",")
        assert any(s.label == label and s.share > 0.8 and s.last_word - s.first_word > 0.9 * size for s in found[i].spans)


def test_template_of_a_thousand_words(spark):
    long = [f"w{i}" for i in range(1000)]
    texts = [" ".join(["a", *long[:500], "x", *long[500:]]), " ".join(long[500:] + long[:500]), " ".join(long[:600])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in scan_licenses(docs, [], [("long", " ".join(long))]).collect()}
    assert [(s.first_word, s.last_word) for s in found[0].spans] == [(1, 1001)] and found[0].score == 996 / 998
    assert found[1].labels == "" and found[2].labels == "" and found[1].score == 0.0


def test_base_phrases_by_brute_force(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op2_license_scan"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id])
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(i, label) for label, phrase in PHRASES for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
        places, labels = sorted(i for i, _ in at), sorted({label for _, label in at})
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(at), ",".join(labels))
        assert (r.first_word, r.last_word) == ((places[0], places[-1]) if places else (None, None))
        assert set(labels) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
