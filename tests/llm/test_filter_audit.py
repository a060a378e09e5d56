"""The filter audit by running all orders one document after the other."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

from airsleuth.llm.filter_audit import FIELD, ORDERS, audit_filters, packed, step_table, unpacked

import pandas as pd


def plain_masks(rows: list[tuple], labels: list[tuple]) -> list[tuple]:
    """Part, failed filters, good and toxic of each row."""
    good, toxic = ({d for d, *flags in labels if d is not None and flags[i] == 1} for i in (0, 1))
    ids: dict[str, list] = {}
    for doc_id, text, _ in rows:
        ids.setdefault(text or "", []).append(doc_id)
    found = []
    for doc_id, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        others = [i for i in ids[text] if i is not None]
        fails = ("A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words))
                 + "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
                 + "E" * (bool(others) and (doc_id is None or min(others) < doc_id)))
        found.append((part or "", fails, doc_id in good, doc_id in toxic))
    return found


def plain_audit(rows: list[tuple], labels: list[tuple]) -> dict[tuple, tuple]:
    documents = plain_masks(rows, labels)
    total: dict[tuple, Counter] = {}
    shapley: Counter = Counter()
    for part in {d[0] for d in documents}:
        for order in map("".join, permutations("ABCDE")):
            left = [(d, False) for d in documents if d[0] == part]
            for step, letter in enumerate(order, 1):
                c = Counter()
                for i, ((_, fails, good, toxic), gone) in enumerate(left):
                    if letter in fails:
                        c["redundant" if gone else "removed"] += 1
                        c["unique"] += fails == letter
                        c["good"] += good and not gone
                        c["toxic"] += toxic and not gone
                        left[i] = (left[i][0], True)
                    elif not gone:
                        c["kept"] += 1
                total[part, order, step] = c
                shapley[part, letter] += c["removed"]
    return {(p, o, s): (c["kept"], c["removed"], c["redundant"], c["unique"], c["good"], c["toxic"], shapley[p, o[s - 1]]) for (p, o, s), c in total.items()}


def audited(df) -> dict[tuple, tuple]:
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_equals_all_orders_one_after_the_other(spark, prose):
    draw = random.Random(3)
    texts = [prose(i, draw.choice([5, 49, 50, 60]), draw.choice([3, 4000])) + draw.choice(["", " ABCDEFGHIJKLMNOP" * 3, " #"]) for i in range(40)]
    rows = [(draw.choice([*range(120), None]), draw.choice([*texts, None, ""]), draw.choice(["s", "s", "t", None, ""])) for _ in range(160)]
    rows += [(7, texts[0], "s"), (7, texts[0], "s"), (9, texts[0], "t"), (None, texts[0], "t"), (None, "only without an id", "t")] + [(200 + i, texts[1], "hot") for i in range(50)]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 260, 2)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "doc_id long, text string, source string, part string, mask int, good boolean").repartition(5)
    got = audited(audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert len(got) == 600 * 4 and got == plain_audit(rows, labels)


def test_odd_documents(spark, odd_documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.text, r.source) for r in odd_documents.collect()]
    assert audited(audit_filters(odd_documents, none)) == plain_audit(rows, [])
    assert audit_filters(odd_documents.limit(0), none).count() == 0


def test_fields_do_not_run_over():
    """Counts near the largest of a column stay in their fields, and all fields of a step add up to the whole."""
    n = (1 << 62) // 32
    whole = step_table(pd.DataFrame({"mask": range(32), "good": True, "toxic": False, "n": n}))
    assert len(whole) == 600 and whole["good_lost"].equals(whole["removed"].rename("good_lost")) and whole["toxic_lost"].sum() == 0
    assert (whole.loc[whole["step"] == 5, "kept"] == n).all() and (whole.loc[whole["step"] == 1, "removed"] == 16 * n).all()
    by_order = whole.groupby("filter_order")["removed"].sum()
    assert (by_order == 31 * n).all() and len(by_order) == len(ORDERS) == 120
    big = (1 << 8 * FIELD - 1) - 1
    assert unpacked(big * packed(31)).max() == big
