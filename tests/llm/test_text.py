"""Words, substring removal, decontamination, near duplicates against brute force."""

import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logmetrics.llm import blocks as B
from logmetrics.llm import decontam, neardup
from logmetrics.llm.decontam import contamination, decontaminate, find_contamination, remove_spans
from logmetrics.llm.neardup import components, drop_near_duplicates, near_duplicates, similarities
from logmetrics.llm.substring import dedup_substrings
from logmetrics.llm.words import ALNUM_WORDS, BLANK_WORDS, cut, grams, text_buffers

DOCS = "doc_id bigint, text string, lang string"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return ALNUM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def some_words(seed, n, among=4000):
    draw = np.random.default_rng(seed)
    return [f"w{k}" for k in draw.integers(0, among, n)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9 \t\n\x0b é_日.", max_size=30)), max_size=8))
def test_cut_is_the_pattern(texts):
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    for kind, pattern in ((BLANK_WORDS, BLANK.findall), (ALNUM_WORDS, lowered)):
        words = cut(data, offsets, kind)
        found = [data[b:e].tobytes().decode() for b, e in zip(words.start, words.end)]
        if kind is ALNUM_WORDS:
            found = [lowered(w)[0] for w in found]
        want = [pattern(t or "") for t in texts]
        assert found == [w for ws in want for w in ws]
        assert words.counts.tolist() == [len(ws) for ws in want]
        by_hash = {}
        for w, h in zip(found, words.hash.tolist()):
            assert by_hash.setdefault(h, w) == w
        assert len(by_hash) == len(set(found))


def test_grams_tell_orders_apart():
    h = np.arange(1, 8, dtype=np.uint64)
    assert grams(h, 3)[0] != grams(h[::-1].copy(), 3)[4]
    assert (grams(np.r_[h, h], 3)[:5] == grams(np.r_[h, h], 3)[7:12]).all()
    assert len(grams(h, 9)) == 0


@given(st.lists(st.integers(0, 2**64 - 1), max_size=30), st.lists(st.integers(-(2**62), 2**62), max_size=30))
@settings(max_examples=60, deadline=None)
def test_packing_round_trip(values, numbers):
    values = np.array(sorted(values), np.uint64)
    assert (B.unpack_sorted(B.pack_sorted(values)) == values).all()
    numbers = np.array(numbers, np.int64)
    assert (B.unpack_ints(B.pack_ints(numbers)) == numbers).all()


def brute_substrings(rows, window=13):
    first, out = {}, {}
    cuts = [(i, BLANK.findall(t or "")) for i, t in rows]
    for i, w in cuts:
        for k in range(len(w) - window + 1):
            if i is not None:
                g = tuple(w[k : k + window])
                first[g] = min(first.get(g, i), i)
    for i, w in cuts:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.setdefault(i, []).append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return {i: sorted(v) for i, v in out.items()}


def substring_rows():
    a, b = some_words(1, 60), some_words(2, 400)
    passage = some_words(3, 55)
    rows = [
        (5, " ".join(a)),
        (2, " ".join(b[:100] + passage + b[100:])),
        (9, "\t".join(passage + a)),
        (7, "  ".join(passage[:13])),
        (8, " ".join(passage[:12])),
        (1, None),
        (3, ""),
        (4, " \n "),
        (6, " ".join(["same"] * 40)),
        (10, " ".join(["same"] * 12 + ["other"] + ["same"] * 20)),
        (11, " ".join(a)),
        (11, " ".join(a)),
        (None, " ".join(a)),
        (-3, " ".join(b[390:] + passage)),
        (12, " ".join(some_words(4, 3000) + passage + ["é x"] * 30)),
    ]
    return rows + [(100 + k, " ".join(passage + some_words(50 + k, 20))) for k in range(30)]


def test_substrings_against_brute_force(spark, tmp_path):
    rows = [(i, t, "xx") for i, t in substring_rows()]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d")).withColumn("N_Words", F.lit("clash"))
    got = {}
    for r in dedup_substrings(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"], r["kept_text"]))
        assert r["lang"] == "xx"
    assert {i: sorted(v) for i, v in got.items()} == brute_substrings(substring_rows())


def test_substrings_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "d"))
    assert dedup_substrings(spark.read.parquet(str(tmp_path / "d"))).count() == 0


def brute_contamination(text, items, window=13):
    w, hit, found = lowered(text), set(), set()
    for item, item_text in items:
        g = lowered(item_text)
        size = min(window, len(g))
        if item is None or not size:
            continue
        windows = {tuple(g[k : k + size]) for k in range(len(g) - size + 1)}
        for k in range(len(w) - size + 1):
            if tuple(w[k : k + size]) in windows:
                hit.update(range(k, k + size))
                found.add(str(item))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def test_contamination_against_brute_force(spark, monkeypatch):
    q = some_words(8, 30)
    items = [(1, " ".join(q)), (2, "Only Three words"), (3, None), (4, " .. "), (None, "lost item"), (10, " ".join(q[:20]))]
    items += [(1, " ".join(q)), (5, "Ähre über 9")]
    texts = [
        " ".join(some_words(9, 50) + q[5:20] + some_words(10, 700)),
        " ".join(q).upper().replace(" ", "--"),
        "say only, THREE words! and Ähre ÜBER 9, ähre über 9",
        None, "", "lost item", " ".join(q[:12]),
        " ".join(some_words(11, 2000)) + " only three words",
    ]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(2, texts[2], "x")], DOCS)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for limit in (32 << 20, 100):
        out = contamination(find_contamination(docs.withColumn("n_hit", F.lit(1)), bench, limit=limit)).collect()
        assert len(out) == len(texts) + 1
        for r in out:
            got = (r["n_words"], r["n_hit"], r["hit_items"], r["contaminated"])
            assert got == brute_contamination(texts[r["doc_id"]], items), r
            assert r["n_items"] == len(r["hit_items"])
    again = bench.unionAll(bench).unionAll(bench)  # repeated items, cut into runs of three windows
    monkeypatch.setattr(decontam, "RUN", 3)
    runs = decontam.item_runs(bench.selectExpr("cast(item_id as string) as item", "coalesce(text, '') as text"), 13, 3)
    assert runs.where("size(split(text, ' ')) > 15").count() == 0 and runs.count() > 10
    out = contamination(find_contamination(docs, again, limit=600)).collect()
    for r in out:
        got = (r["n_words"], r["n_hit"], r["hit_items"], r["contaminated"])
        assert got == brute_contamination(texts[r["doc_id"]], items), r
    kept = {r["doc_id"] for r in decontaminate(docs, bench).collect()}
    assert kept == {k for k, t in enumerate(texts) if not brute_contamination(t, items)[3]}
    cleaned = {r["doc_id"]: r["text"] for r in remove_spans(find_contamination(docs, bench)).collect()}
    assert cleaned[2] == "say ! and Ähre ÜBER 9, ähre über 9" and cleaned[4] == "" and cleaned[3] is None
    assert find_contamination(docs.limit(0), bench).count() == 0
    assert find_contamination(docs, bench.limit(0)).where("size(hit_spans) > 0").count() == 0


def weights(text):
    w = BLANK.findall(text or "")
    size = min(5, len(w))
    grams_of = Counter(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if size else {}
    return {g: 1 + math.log2(c) for g, c in grams_of.items()}


def brute_similarity(a, b):
    x, y = weights(a), weights(b)
    common = sum(min(v, y[g]) for g, v in x.items() if g in y)
    total = sum(x.values()) + sum(y.values()) - common
    return common / total if total else 0.0


def test_similarity_is_exact():
    a = [" ".join(some_words(1, 40)), "a b", "x y x y x y x y x y", "", "one two three four five six"]
    b = [" ".join(some_words(1, 40)[:35]), "a b", "x y x y x y", "z", "one two three four five six six"]
    got = similarities([t.encode() for t in a], [t.encode() for t in b])
    assert got == pytest.approx([brute_similarity(x, y) for x, y in zip(a, b)])


def near_rows():
    rows, at = [], 0
    draw = np.random.default_rng(0)
    for group in range(12):
        base = some_words(100 + group, int(draw.integers(60, 400)))
        for copy in range(int(draw.integers(1, 9))):
            w = list(base)
            for _ in range(int(draw.integers(0, 2 + len(w) // 60))):
                w[int(draw.integers(0, len(w)))] = f"new{at}"
            rows.append((at, " ".join(w)))
            at += 1
    boiler = some_words(77, 100)
    rows += [(at + k, " ".join(boiler + some_words(900 + k, 60))) for k in range(40)]
    at += 40
    rows += [(at, None), (at + 1, ""), (at + 2, ""), (at + 3, "two words"), (at + 4, "two words"), (None, rows[0][1])]
    rows += [rows[3], rows[3], (at + 9, rows[0][1])]
    # Ids with several texts: 5005 joins the texts of 5001 and 5002; 5007 has two unlike ones.
    a, b, c, d = (" ".join(some_words(700 + k, 80)) for k in range(4))
    rows += [(5001, a), (5002, b), (5005, a), (5005, b), (5007, c), (5007, d), (5007, None), (5008, c + " end"), (5009, d)]
    return rows + [(5007, c), (5011, ""), (5011, None)]


def brute_classes(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    text = {}
    for i, t in rows:
        text.setdefault(i, []).append(t)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(weights(x) and brute_similarity(x, y) >= 0.8 for x in text[a] for y in text[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicates_against_brute_force(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS).withColumn("class_id", F.lit(0))
    out = near_duplicates(docs).collect()
    assert len(out) == len(rows)
    want = brute_classes(rows)
    assert {r["doc_id"]: r["class_id"] for r in out} == want | {None: None}
    kept = drop_near_duplicates(docs).collect()
    # One document of each class, with both its texts where they are unlike.
    once = sorted(r["doc_id"] for r in kept if r["doc_id"] is not None)
    assert once == sorted([*set(want.values()), 5007])
    texts = {i: {t for k, t in rows if k == i} for i in (5007,)}
    assert {r["text"] for r in kept if r["doc_id"] == 5007} == texts[5007] - {None}
    assert sum(r["doc_id"] is None for r in kept) == 1


def test_near_duplicates_of_hot_templates(spark, monkeypatch):
    """Texts of two templates, most pairs a little under 0.8; buckets are cut into several blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 32)
    texts, draw = [], np.random.default_rng(4)
    for family in range(2):
        base = some_words(300 + family, 150)
        for _ in range(200):
            w = list(base)
            for place in draw.choice(len(w), int(draw.integers(1, 6)), replace=False):
                w[place] = f"slot{family}x{int(draw.integers(0, 4))}"
            texts.append(" ".join(w).encode())
    edges = []
    for k in range(len(texts) - 1):
        alike = similarities([texts[k]] * (len(texts) - k - 1), texts[k + 1 :]) >= 0.8
        edges += [(k, k + 1 + int(j)) for j in np.flatnonzero(alike)]
    want = {k: k for k in range(len(texts))}
    for _ in texts:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    docs = spark.createDataFrame([(k, t.decode(), "x") for k, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs).collect()}
    assert got == want and 2 < len(set(want.values())) < len(texts)


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert near_duplicates(empty).count() == 0 and drop_near_duplicates(empty).count() == 0


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, 90), (90, 95), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {k: 0 for k in range(21)} | {k: 90 for k in (90, 95, 100)}


def test_checked_pairs_do_not_hold_a_whole_batch():
    text = " ".join(some_words(5, 2_000, 100_000))
    pairs = [(k, -k, text, text if k % 2 else text[: len(text) // 2]) for k in range(1, 1921)]
    names = ["node", "leader", "text", "other"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*pairs, strict=True)], names)
    tracemalloc.start()
    got = [r for out in neardup._check(0.8)(iter([batch])) for r in out.to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [{"node": k, "leader": -k, "linked": k % 2 == 1} for k in range(1, 1921)]
    assert most < 1.5 * batch.nbytes
    assert list(neardup._check(0.8)(iter([batch.slice(0, 0)]))) == []
