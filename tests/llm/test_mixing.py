"""Fill-in-the-middle, importance resampling and mixing against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logmetrics.llm import mix, resample
from logmetrics.llm.middle import Blocks, move_middles, restore_texts

DOCS = "doc_id bigint, text string, lang string"


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab é日😀 \n", max_size=90), st.integers(1, 9), st.booleans())
def test_cuts_are_at_units(text, size, words):
    pattern = re.compile(r"\S+") if words else None
    data = np.frombuffer(text.encode(), np.uint8)
    blocks = Blocks(data, pattern, size)
    begins = [m.start() for m in re.finditer(r"\S+", text)] if words else list(range(len(text)))
    begins[:1] = [0] if begins else []
    assert blocks.total == len(begins)
    for after in range(blocks.total + 1):
        point = begins[after] if after < len(begins) else len(text)
        assert blocks.cut(after) == (len(text[:point].encode()), point)


def brute_middle(doc_id, text):
    text, n = text or "", len(text or "")
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_middles_against_brute_force(spark):
    draw = np.random.default_rng(5)
    letters = list("ab<>PSM é日😀\n\t")
    texts = ["".join(draw.choice(letters, int(draw.integers(0, 900)))) for _ in range(150)]
    rows = [(k, t, "x") for k, t in enumerate(texts)]
    rows += [(None, "no id at all", "x"), (-5, None, "x"), (500, "", "x"), (501, "has <M> inside", "x"), (502, "<P", "x")]
    rows += [(7, "repeated", "x"), (7, "repeated", "x"), (503, "é日" * 300_000, "x"), (504, "S>" * 50, "x")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("FIM_text", F.lit("clash"))
    got = restore_texts(move_middles(docs)).collect()
    fields = ("fim_units", "fim_form", "prefix_chars", "middle_chars", "fim_text")
    assert sorted((r["doc_id"] or 0, tuple(r[f] for f in fields)) for r in got if r["fim_form"] == "plain") == sorted(
        (i or 0, w) for i, t, _ in rows if (w := brute_middle(i, t))[1] == "plain"
    )
    assert sorted((r["doc_id"] or 0, tuple(r[f] for f in fields)) for r in got if r["fim_form"] != "plain") == sorted(
        (i or 0, w) for i, t, _ in rows if (w := brute_middle(i, t))[1] != "plain"
    )
    assert {r["fim_form"] for r in got} == {"plain", "psm", "spm"}
    assert all(r["restored_text"] == (r["text"] or "") and r["lang"] == "x" for r in got)
    assert move_middles(docs.limit(0)).count() == 0


def test_middles_of_words_and_other_markers(spark):
    marks = ("[pre]", "[suf]", "[mid]")
    docs = spark.createDataFrame([(k, " one two  three\nfour", "x") for k in range(40)], DOCS)
    moved = move_middles(docs, pattern=r"\S+\s*", markers=marks, plain=0, spm=50)
    for r in restore_texts(moved, markers=marks).collect():
        assert r["restored_text"] == r["text"] and r["fim_units"] == 4 and r["fim_form"] != "plain"
        assert r["prefix_chars"] in (0, 5, 10, 16, 20)
    broken = moved.withColumn("fim_text", F.when(F.col("doc_id") == 0, "cut off").otherwise(F.lit(None)))
    assert [r["restored_text"] for r in restore_texts(broken, markers=marks).collect()] == [None] * 40
    for marks in (("<P>", "<P>", "<M>"), ("aba", "c", "d"), ("", "c", "d")):
        with pytest.raises(ValueError):
            move_middles(docs, markers=marks)


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aB9 \t.é日-z", max_size=60), st.integers(1, 4))
def test_spans_are_all_runs(text, at_once):
    words, buckets = brute_features(text)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(resample, "_AT_ONCE", at_once)
        n, hit, times = resample.bucket_counts(text.encode(), resample.span_pattern(3), 3, 10000)
    assert n == words and dict(zip(hit.tolist(), times.tolist())) == Counter(buckets)
    assert list(hit) == sorted(hit)


def brute_resample(rows, target):
    features = [(i, *brute_features(t)) for i, t in rows]
    source = Counter(b for *_, f in features for b in f)
    wanted = Counter(b for t in target for b in brute_features(t)[1])
    s_all, t_all = sum(source.values()), sum(wanted.values())
    gain = {
        b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10000) / ((source[b] + 1) * (t_all + 10000))))
        for b in source
    }
    out = []
    for i, n, f in features:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((-s, i is None, i or 0, w, f, n) for i, f, w, s, n in out if n >= 20)[: 5 * sum(r[4] >= 20 for r in out) // 100]
    ranks = {}
    for place, key in enumerate(able):
        ranks.setdefault(key, []).append(place + 1)
    result = []
    for i, f, w, s, n in out:
        own = ranks.get((-s, i is None, i or 0, w, f, n)) if n >= 20 else None
        result.append((i, f, w, s, own.pop(0) if own else None, n))
    return result


def resample_rows():
    draw, rows = np.random.default_rng(9), []
    for k in range(260):
        words = [f"w{x}" for x in draw.integers(0, 60 if k % 5 == 0 else 900, int(draw.integers(0, 60)))]
        rows.append((k, ", ".join(words).title() if k % 2 else " ".join(words)))
    rows += [(None, " ".join(f"w{x}" for x in range(30))), (1000, None), (1001, ""), (1002, " .. - "), (-4, "é " * 50)]
    return rows + [(k, "the same words again " * 8) for k in range(2000, 2060)] + [(2000, "the same words again " * 8)] * 30


def by_text(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_resampling_against_brute_force(spark):
    rows = resample_rows()
    target = ["The same words", None, "w1 w2 w3 w4 w5 " * 10, ""]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS).repartition(3).withColumn("Rank", F.lit("clash"))
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(docs, items).collect()
    fields = ("doc_id", "n_features", "weight", "score", "rank", "n_words")
    assert by_text(tuple(r[f] for f in fields) for r in got) == by_text(brute_resample(rows, target))
    drawn = sorted(r["rank"] for r in got if r["rank"])
    assert drawn == list(range(1, len(drawn) + 1)) and len(drawn) == 5 * sum(r["n_words"] >= 20 for r in got) // 100
    assert {(r["doc_id"], r["text"], r["lang"]) for r in got} == {(i, t, "x") for i, t in rows}


def test_resampling_of_little(spark):
    docs = spark.createDataFrame([(k, "one two " * 15, "x") for k in range(19)], DOCS)
    none = docs.limit(0)
    assert resample.resample(none, docs).count() == 0
    out = resample.resample(docs, none).collect()
    assert len(out) == 19 and all(r["rank"] is None and r["n_features"] == 87 for r in out)
    more = resample.resample(docs.unionAll(docs.limit(1)), docs, percent=100).collect()
    assert sorted(r["rank"] for r in more) == list(range(1, 21))


def test_resampling_of_a_long_text(spark):
    text = "Long words-of a text. " * 40_000
    row = resample.resample(spark.createDataFrame([(1, text, "x")], DOCS), spark.createDataFrame([(text,)], "text string"))
    assert row.first()["n_words"] == 200_000 and row.first()["n_features"] == 3 * 200_000 - 3


BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """(source, target) by sharing again and again, in exact fractions."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, free = {}, Fraction(sum(sizes.values())), set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s for s in free if share[s] > most * sizes[s]}
        if not above:
            return names, target | share
        for s in above:
            target[s] = Fraction(most * sizes[s])
            left -= target[s]
        free -= above
    return names, target


def brute_mix(rows, words, shards, most=3, seed=23):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(BLANK.findall(t or ""))
    names, target = brute_targets(sizes, most=most)
    seats, cuts = dict.fromkeys(names, 0), {s: [0] for s in names}
    house = (sum(sizes.values()) + words // 2) // words
    for k in range(1, shards + 1):
        while sum(seats.values()) < k * house // shards:
            best = max(names, key=lambda s: (float(target[s]) / (2 * seats[s] + 1), -names.index(s)))
            seats[best] += 1
        for s in names:
            cuts[s].append(seats[s])
    out = Counter()
    for source in names:
        own = [(i, t) for i, t, s in rows if s == source]
        order = lambda r: (
            hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest(),
            r[0] is not None, r[0] or 0,
        )
        stream = [(k, w) for k, (_, t) in enumerate(sorted(own, key=order)) for w in range(len(BLANK.findall(t or "")))]
        takes = [[] for _ in own]
        for shard in range(shards):
            for at in range(cuts[source][shard] * words, min(cuts[source][shard + 1] * words, most * len(stream))):
                takes[stream[at % len(stream)][0]].append((shard, at // len(stream), stream[at % len(stream)][1]))
        for (i, t), got in zip(sorted(own, key=order), takes, strict=True):
            pieces = Counter()
            for shard, turn, word in got:
                pieces[shard, turn] += 1
            first = {key: min(w for s, r, w in got if (s, r) == key) for key in pieces}
            spans = sorted((turn, shard, first[shard, turn], first[shard, turn] + n) for (shard, turn), n in pieces.items())
            out[i, t, source, sizes[source], float(target[source]), len(got), tuple(x[1:] for x in spans)] += 1
    return out


def mix_rows(seed):
    draw, rows = np.random.default_rng(seed), []
    for k in range(160):
        source = ["hot", "hot", "b", "Ä", "", None, "tiny"][int(draw.integers(0, 6))] if k else "tiny"
        rows.append((k, " \t".join(f"w{x}" for x in draw.integers(0, 99, int(draw.integers(0, 40)))), source))
    rows += [(None, "no id", "b"), (200, None, "b"), (201, "", None), (202, " \n ", "nothing"), (203, None, "nothing")]
    return rows + [(300, "the same row", "hot")] * 70 + [(k, "the same text", "hot") for k in range(301, 320)]


@pytest.mark.parametrize("words,shards,most", [(None, 16, 3), (7, 5, 3), (40, 3, 2)])
def test_mix_against_brute_force(spark, words, shards, most):
    rows = mix_rows(words or 0)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    docs = docs.withColumn("Pieces", F.lit(1))
    got = mix.mix_sources(docs, words=words, shards=shards, most=most, range_rows=8).collect()
    assert len(got) == len(rows)
    want = brute_mix(rows, words or 1, shards, most)  # the smallest source has less than 256 words
    fields = ("doc_id", "source", "source_size", "target", "taken")
    mine = Counter((*(r[f] for f in fields), tuple(tuple(p) for p in r["pieces"])) for r in got)
    assert mine == Counter({}) + sum((Counter({(i, s, n, t, k, p): c}) for (i, _, s, n, t, k, p), c in want.items()), Counter())
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= most * r["size"]
    assert all(abs(taken[s] - t) <= 2 * (words or 1) for s, t in target.items())


def test_mixed_texts_are_the_pieces(spark):
    rows = mix_rows(4)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("shard", F.lit("clash"))
    pieces = mix.mixed_texts(docs, shards=4).collect()
    taken = Counter()
    for r in mix.mix_sources(docs, shards=4).collect():
        for p in r["pieces"]:
            taken[r["doc_id"], r["source"], p["shard"], p["begin"], p["end"]] += 1
    text = {(i, s): BLANK.findall(t or "") for i, t, s in rows}
    assert Counter((r["doc_id"], r["source"], r["shard"], r["begin"], r["end"]) for r in pieces) == taken
    assert all(r["text"] == " ".join(text[r["doc_id"], r["source"]][r["begin"] : r["end"]]) for r in pieces)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text(max_size=2)), st.integers(0, 50), min_size=1, max_size=6))
def test_shared_targets_add_up(sizes):
    _, target = brute_targets(sizes)
    assert sum(target.values()) == sum(sizes.values()) and all(target[s] <= 3 * n for s, n in sizes.items())


def test_mix_of_little(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id bigint, text string, source string")
    assert mix.mix_sources(docs.limit(0)).count() == 0
    assert [(r["target"], r["taken"], r["pieces"]) for r in mix.mix_sources(docs).collect()] == [(0.0, 0, [])] * 2
    one = spark.createDataFrame([(1, "a b c", "a")], docs.schema)
    assert mix.mix_sources(one).first()["taken"] == 3 and mix.mixed_texts(one, shards=2).count() == 2
