"""Fill-in-the-middle by brute force over units cut with a pattern, and an exact round trip."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np

from airsleuth.llm.fill_in_middle import Marks, as_words, code_point_starts, fill_in_middle, restore, unit_ends

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id: int, text: str, percent: int = 50, spm: int = 80) -> tuple:
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_equals_brute_force_and_restores(spark):
    draw = random.Random(5)
    letters = [" ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c", "a", "bc", "word", "é", "日本", "\U0001F600", "\x00", "\x1f", "\x08", "\x0e", "\x7f", "\x85", "\xa0",
               " ", "<", "<P", "P>", "S>", "<P>", "<M>"]
    texts = ["".join(draw.choices(letters, weights=[3] * 25 + [0.1] * 2, k=draw.randrange(30))) for _ in range(3000)]
    texts += ["", " ", "\n\n", "x", " x", "x ", "word " * 5000, "日" * 3000]
    rows = list(enumerate(texts))
    for percent, spm in ((50, 80), (100, 50), (0, 80)):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        found = restore(fill_in_middle(docs, percent, spm)).collect()
        assert len(found) == len(rows)
        for r in found:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, texts[r.doc_id], percent, spm), repr(texts[r.doc_id])
            assert r.text == texts[r.doc_id]
    forms = [plain(i, "a word")[1] for i in range(len(rows))]
    assert {f: round(forms.count(f) / len(rows), 1) for f in set(forms)} == {"plain": 0.5, "spm": 0.4, "psm": 0.1}


def test_rank_and_select_by_counting():
    draw = np.random.default_rng(1)
    for _ in range(200):
        data = draw.choice(np.frombuffer(" \t\r\nab\xc3\xa9\xe6\x97\xa5".encode("latin-1"), "u1"), draw.integers(1, 60))
        words = as_words(data)
        spaces = [b in b" \t\n\r\x0b\x0c" for b in data.tolist()]
        ends = [i for i in range(len(data)) if i == len(data) - 1 or (not spaces[i] and spaces[i + 1])]
        marks = Marks(unit_ends(words, np.array([len(data)])))
        places = np.arange(len(data) + 1)
        assert marks.rank(places).tolist() == [sum(e < p for e in ends) for p in places]
        assert marks.select(np.arange(1, len(ends) + 1)).tolist() == [e + 1 for e in ends]
        starts = Marks(code_point_starts(words))
        assert starts.rank(places).tolist() == [sum(b & 0xC0 != 0x80 for b in data[:p].tolist()) for p in places]


def test_odd_documents(odd_documents):
    rows = restore(fill_in_middle(odd_documents)).collect()
    assert len(rows) == 10 and [r.form for r in rows if r.doc_id in (2, 3)] == ["plain"] * 2
    given = {r.doc_id: r.text or "" for r in odd_documents.collect()}
    assert all(r.text == given[r.doc_id] for r in rows) and {r.n for r in rows if r.doc_id == 4} == {1}
    assert len({r.output for r in rows if r.doc_id == 1}) == 1
    assert fill_in_middle(odd_documents.limit(0)).count() == 0
