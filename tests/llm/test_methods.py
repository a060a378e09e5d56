"""Operators beside brute force on small fixtures."""

from __future__ import annotations

import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from airsleuth.llm.decontaminate import BLOCKS, OP1_SQL, RADIUS, _block_values, _near_values, drop_contaminated, find_items
from airsleuth.llm.fingerprints import HASH_SHIFT, K, SLACK, fingerprint_documents, with_anchors, with_likeness
from airsleuth.llm.language_model import mixture_weight, score_documents
from airsleuth.llm.licenses import PHRASES, scan_licenses
from airsleuth.llm.line_dedup import boilerplate, drop_boilerplate
from airsleuth.llm.near_dedup import near_duplicates
from airsleuth.llm.packing import first_fit_decreasing, pack
from airsleuth.llm.quality import _first_rows
from airsleuth.llm.tables import freeing
from airsleuth.llm.token_files import CorruptFile, FrameReader, open_store, read_token_files, write_token_files
from airsleuth.llm.url_filter import judge
from airsleuth.llm.word_ids import WordIds
from airsleuth.session import scratch_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(autouse=True)
def clean():
    with freeing():
        yield


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def _shingles(text, k):
    w = text.lower().split()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_duplicates_by_brute_force(spark, prose):
    """Copies of one short text with one to six edits: many share buckets but are no links."""
    draw, texts = random.Random(0), []
    for base in (prose(1, 60), prose(2, 200)):
        for _ in range(150):
            w = base.split()
            for _ in range(draw.randrange(7)):
                w[draw.randrange(len(w))] = f"new{draw.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += [prose(i, 100) for i in range(10, 40)]
    sets = [_shingles(t, 4) for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    got = {r.doc_id: r for r in near_duplicates(_docs(spark, texts), words=4).collect()}
    assert [got[i].component_id for i in range(len(texts))] == label
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]


def test_all_fingerprints_within_the_radius_share_a_block(spark):
    draw = random.Random(0)
    rows = []
    for i in range(200):
        x = draw.getrandbits(64)
        y = x
        for b in draw.sample(range(64), RADIUS if i % 2 else draw.randrange(RADIUS)):
            y ^= 1 << b
        rows.append((x - (1 << 64) if x >> 63 else x, y - (1 << 64) if y >> 63 else y))
    df = spark.createDataFrame(rows, "x long, y long")
    met = df.filter(F.size(F.array_intersect(_near_values(F.col("x")), _block_values(F.col("y")))) > 0)
    assert met.count() == 200 and sum(BLOCKS) == 64


def test_edited_items_are_found(spark, prose):
    items = [prose(i, n) for i, n in enumerate((12, 30, 58, 58))]
    w = items[2].split()
    w[25] = "changed"  # one edit of 58 words costs five of 54 runs
    texts = [f"{prose(99, 40)} {items[0].upper()}, {prose(98, 7)}", f"{items[1]}! {prose(97, 400)}", " ".join(w), " ".join(items[3].split()[:40]),
             prose(96, 300)]
    rows = find_items(_docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    got = {(r.doc_id, r.item_id): (round(r.similarity, 4), r.first_word, r.n_words) for r in rows.collect()}
    assert got == {(0, 0): (1.0, 40, 12), (1, 1): (1.0, 0, 30), (2, 2): (round(49 / 59, 4), 0, 58)}


def test_documents_shorter_than_an_item_are_found(spark, prose):
    """An item with a word missing, as a whole page, has fewer runs than the item."""
    items = [prose(i, n) for i, n in enumerate((58, 30, 14))]
    w = items[0].split()
    texts = [" ".join(w[:25] + w[26:]), " ".join(items[1].split()[1:]), " ".join(items[2].split()[:-3]), prose(96, 50)]
    found = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 4), r.first_word, r.n_words) for r in find_items(_docs(spark, texts), found).collect()}
    # Of 10 runs the third item's page has 7: 0.7 is not enough.
    assert got == {(0, 0): (round(49 / 58, 4), 0, 57), (1, 1): (round(25 / 26, 4), 0, 29)}
    assert sorted(r.doc_id for r in drop_contaminated(_docs(spark, texts), found).collect()) == [2, 3]
    database = duckdb.connect()
    database.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": texts}))
    database.register("benchmark", pa.table({"item_id": list(range(len(items))), "text": items}))
    rows = database.sql(OP1_SQL).fetchall()
    assert {(d, i): (round(s, 4), first, n) for d, i, s, first, n in rows} == got


def test_boilerplate_must_be_proven(spark):
    """The least number of pages that is two deviations above a twentieth, for hosts of several sizes."""
    rows, want = [], {}
    for total in (4, 8, 20, 100, 500):
        least = next(k for k in range(total + 1) if k > 0.05 * total + 2 * (total * 0.05 * 0.95) ** 0.5)
        least = max(5, least)
        for page in range(total):
            lines = [f"own {total} {page}", *(["most"] if page < least else []), *(["few"] if page < least - 1 else [])]
            rows.append((len(rows), f"h{total}", "\n".join(lines)))
        want[f"h{total}"] = least if least <= total else 0
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = drop_boilerplate(docs).groupBy("source").agg(F.sum("n_dropped").alias("n")).collect()
    assert {r.source: r.n for r in got} == want


def test_license_spans(spark, prose):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the Software), to deal in the Software without restriction")
    texts = [f"{prose(1, 50)} Released under the MIT License. {prose(2, 9)} UNDER THE MIT\nlicense",
             f"{prose(3, 20)} {mit.replace('of this', 'of all this')} {prose(4, 5)}", "Apache License, Version 2.0; CC BY-NC 4.0",
             "licensed under the GNU General Public License, version 3", prose(5, 30), "cc by", "cc by nc by nc cc by nc"]
    got = {r.doc_id: r for r in scan_licenses(_docs(spark, texts)).collect()}
    assert [got[i].n_base for i in range(7)] == [2, 0, 2, 0, 0, 0, 2] and (got[0].first_word, got[0].last_word) == (51, 64)
    assert [got[i].labels for i in range(7)] == ["mit", "mit", "apache-2,cc-by-nc", "gpl-3", "", "", "cc-by-nc"]
    assert got[2].base_labels == "apache-2,cc-by-nc" and got[1].base_labels == "" and 0.7 <= got[1].score < 1 and len(PHRASES) == 3


def test_language_model_by_brute_force(spark, prose):
    texts = [prose(i, 80, 40) for i in range(60)]
    rows = {r.doc_id: r for r in score_documents(_docs(spark, texts)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in rows}
    tokens = {i: [*t.split(), None] for i, t in enumerate(texts)}
    words, pairs = {}, {}
    for i, t in tokens.items():
        for a, b in zip([None, *t], t) if not held[i] else ():
            words[b] = words.get(b, 0) + 1
            pairs[a, b] = pairs.get((a, b), 0) + 1
    n, v = sum(words.values()), len(words)
    for i, t in tokens.items():
        base = sum(np.log10((words.get(w, 0) + 1) / (n + v + 1)) for w in t)
        assert rows[i].base_score == pytest.approx(base) and rows[i].held_out == held[i] and rows[i].train_tokens == n
        assert rows[i].n_tokens == len(t) and rows[i].n_known == sum(w in words for w in t)
    # A pair share, a word share and the floor, each with its weight: a training text is likelier by the model.
    train = [i for i in rows if not held[i]]
    assert sum(rows[i].score for i in train) > sum(rows[i].base_score for i in train)
    assert mixture_weight(np.array([0.0, 4.0]), np.array([50, 50])) == pytest.approx(1 / 3, abs=1e-3)


def test_probabilities_sum_to_one(spark, prose):
    """Over all known words and one unknown, after any context."""
    base = [prose(i, 30, 10) for i in range(12)]
    known = sorted({w for t in base for w in t.split()})
    # Ids of probes are held out, so they change no count.
    ids = [i for i in range(100, 4000) if zlib.crc32(str(i).encode()) % 7 == 2][:len(known) + 2]
    first = known[0]
    probes = [f"{first} {w}" for w in [*known, "unheard"]] + [first]
    free = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [*zip(free, base), *zip(ids, probes)]
    got = {r.doc_id: r for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # p(first) p(end | first) and p(first) p(w | first) p(end | w); the share of w is what the end's cannot tell.
    assert all(got[i].score < 0 for i in ids) and not any(got[i].held_out for i in free[:len(base)])


@pytest.mark.parametrize("rows", [90, 101, 130, 150, 161, 400, 5000])
def test_first_rows_are_the_smallest_hashes(spark, rows):
    df = spark.range(rows).select(F.xxhash64("id").alias("hash"), F.col("id").alias("x"))
    expected = sorted(r[0] for r in df.select("hash").collect())[:100]
    assert sorted(r.hash for r in _first_rows(df, 100).collect()) == expected


def test_first_fit_decreasing_by_brute_force():
    draw = np.random.default_rng(0)
    for n in (1, 2, 7, 300):
        lengths = draw.integers(1, 101, n)
        bins, places = first_fit_decreasing(lengths, 100)
        room, expected = [], np.empty(n, int)
        for i in sorted(range(n), key=lambda i: -lengths[i]):
            b = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
            if b == len(room):
                room.append(100)
            room[b] -= lengths[i]
            expected[i] = b
        assert bins.tolist() == expected.tolist()
        for b in set(bins.tolist()):
            inside = sorted((places[i], lengths[i]) for i in range(n) if bins[i] == b)
            assert [p for p, _ in inside] == np.cumsum([0, *[size for _, size in inside[:-1]]]).tolist()


def test_packing_and_files_by_the_tokenizer(spark, prose, tmp_path):
    texts = [prose(i, n) for i, n in enumerate((5, 3000, 700, 1, 900, 40))] + ["It's <|endoftext|> O'Neill's 12a\u00e9 \u1e9e x\x1cy na\u00efve!!! ..."]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    ids = [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for t in texts]
    docs = _docs(spark, texts)
    for r in pack(docs, group=4).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes())
    rows = pack(docs, group=4).toPandas()
    assert rows["length"].sum() == sum(map(len, ids))
    for _, part in rows.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]] and part["length"].sum() <= 2048
    manifest = write_token_files(docs, scratch_path(spark, "ids"), frame_ids=500, parts=2)
    start = 0
    for r, own in zip(read_token_files(spark, manifest).orderBy("doc_id").collect(), ids):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)


def test_a_reader_opens_only_the_frames_it_needs_and_finds_damage(spark, prose):
    manifest = write_token_files(_docs(spark, [prose(i, 400) for i in range(6)]), scratch_path(spark, "ids"), frame_ids=100, parts=1)
    store, place = open_store(manifest[0][0])
    with store.open_input_file(place) as file:
        reader = FrameReader(file)
        opened, whole = [], reader.frame
        reader.frame = lambda n: opened.append(n) or whole(n)
        assert sum(len(part) for part in reader.document(2)) == 4 * reader.counts[2]
        assert 0 < len(opened) <= reader.counts[2] // 100 + 2 < len(reader.frames)
        broken = opened[0]
        size, plain, checksum = reader.frames[broken]
        reader.frames[broken] = (size, plain, checksum ^ 1)
        with pytest.raises(CorruptFile):
            whole(broken)


def test_word_cache_forgets_and_stays_right(prose):
    words = WordIds(TOKENIZER)
    text = prose(0, 500)
    first = words.encode(text)
    words.young, words.old = {}, words.young
    assert words.encode(text) == first
    words.young, words.old = {}, {}
    assert words.encode(text) == first


def _anchors(text):
    """Closed syncmers in Python; the words of ``text`` are short."""
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in text.split()]
    row = [x - (1 << 64) if x >> 63 else x for x in hashes] + [-(1 << 63)] * (K - 1)
    found = {}
    for i in range(len(hashes)):
        run = row[i:i + K]
        if min(run[0], run[-1]) <= min(run[1:-1]):
            h = 42
            for x in run:
                h = xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), h)
            found.setdefault(h >> (HASH_SHIFT + 1), i)
    return [(h << HASH_SHIFT) | (i << 1) for h, i in sorted(found.items())]


def _likeness(a, b):
    x, y = ({v >> HASH_SHIFT: v % (1 << HASH_SHIFT) >> 1 for v in c} for c in (a, b))
    offsets = [y[h] - x[h] for h in x.keys() & y.keys()]
    most = max((sum(o <= q <= o + SLACK for q in offsets) for o in offsets), default=0)
    return most / len(x.keys() | y.keys()) if x or y else 1.0


def test_fingerprints_by_brute_force(spark, prose):
    texts = [prose(i, n) for i, n in enumerate((40, 300, 60, 90, 3, 1, 0))]
    # Long words go to pieces, which this brute force does not know.
    texts = [" ".join(w[:12] for w in t.split()) for t in texts]
    rows = {r.doc_id: r for r in fingerprint_documents(_docs(spark, texts)).collect()}
    for i, text in enumerate(texts):
        following, third = texts[(i - 1) % len(texts)], len(text) // 3
        edited = text[:len(text) - third] + following[:third]
        assert rows[i].edited == edited and rows[i].anchors == _anchors(text)
        # The cut may make one word of two.
        if max(map(len, edited.split()), default=0) <= 12:
            assert rows[i].edited_anchors == _anchors(edited)
        assert rows[i].near_edited == pytest.approx(_likeness(rows[i].anchors, rows[i].edited_anchors))
        assert rows[i].near_next == pytest.approx(_likeness(rows[i].anchors, _anchors(following)))
    assert all(rows[i].near_edited > 0.3 > rows[i].near_next for i in range(4))


def test_a_passage_of_long_texts_is_seen(spark, prose):
    """A hundred words that two texts of 20,000 share, and moved passages that agree in no offset."""
    draw = random.Random(7)
    words = lambda n: " ".join(f"w{draw.randrange(1 << 40)}" for _ in range(n))
    passage = words(100)
    a, b = f"{words(15_000)} {passage} {words(5_000)}", f"{words(3_000)} {passage} {words(17_000)}"
    parts = [words(30) for _ in range(10)]
    moved = " ".join(reversed(parts))
    df = spark.createDataFrame([(0, a, b), (1, " ".join(parts), moved), (2, a, a)], "id long, a string, b string")
    df = with_likeness(with_anchors(with_anchors(df, "a", "x"), "b", "y"), "x", "y", "near")
    rows = {r.id: r for r in df.collect()}
    assert 30 / 20_000 < rows[0].near < 70 / 20_000 and 0.02 < rows[1].near < 0.2 and rows[2].near == 1.0
    assert all(rows[i].near == pytest.approx(_likeness(rows[i].x, rows[i].y)) for i in range(2))


def test_insertions_at_the_start_keep_the_likeness(spark, prose):
    """Short and spaceless texts, and texts on both sides of a length; places and pieces are of whole characters."""
    draw = random.Random(0)
    han = "".join(chr(draw.randrange(0x4E00, 0x9000)) for _ in range(400))
    faces = "".join(chr(draw.randrange(0x1F600, 0x1F640)) + draw.choice("abcdefgh") for _ in range(90))
    short, three = prose(1, 14), "incontrovertible counterevidence notwithstanding"
    cut = prose(2, 40)[:168]
    pairs = [(short, f"z{short}"), (han, f"z{han}"), (faces, f"z{faces}"), (three, f"z{three}"), (prose(3, 24), f"zz {prose(3, 24)}"),
             (prose(4, 23), f"zz {prose(4, 23)}"), (cut, cut[12:]), (short, han), (prose(5, 20), prose(6, 20)), ("a", "a"), ("", " \n")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id long, a string, b string")
    df = with_likeness(with_anchors(with_anchors(df, "a", "x"), "b", "y"), "x", "y", "near")
    near = {r.id: r.near for r in df.collect()}
    assert min(near[i] for i in range(7)) > 0.5 and near[7] == 0 and near[8] < 0.1 and near[9] == near[10] == 1


def test_line_shares_are_of_the_site(spark):
    rows = [(i, "a" if i < 20 else "b", f"own {i}\nshared\n\nshared" if i % 2 else f"own {i}") for i in range(40)]
    rows += [(i, "b", "plain") for i in range(40, 240)]
    got = drop_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string"), ratio=0.2).collect()
    text = {r.doc_id: (r.text, r.n_dropped) for r in got}
    assert text[1] == ("own 1\n", 2) and text[2] == ("own 2", 0) and text[21] == ("own 21\nshared\n\nshared", 0) and text[100] == ("", 1)


def test_hosts_are_written_by_more_than_one_task(spark):
    rows = [(i, f"h{i % 40}", f"own {i}\nshared") for i in range(400)]
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        found = boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string"), "source")
    finally:
        spark.conf.unset(key)
    assert found.count() == 40 and len(found.inputFiles()) > 1


@pytest.mark.parametrize("level_bytes", [1 << 20, 64])
def test_cascade_is_exact(spark, level_bytes):
    """Also where the list does not fit one filter and is cut into shards."""
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.net/"), "id").alias("url"))
    limit = 700 if level_bytes > 64 else 90
    listed = spark.range(limit).select(F.concat(F.lit("h.net/"), F.col("id") * 3).alias("key"))
    got = judge(pages, listed, [], level_bytes).filter("verdict = 'block'").select("page_id").collect()
    assert sorted(r[0] for r in got) == [3 * i for i in range(limit)]
