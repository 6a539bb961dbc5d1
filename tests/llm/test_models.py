"""Language identification, toxicity and the pipeline: held-out accuracy, brute force, odd input."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from logmetrics.llm import stages
from logmetrics.llm.langid import UNKNOWN, predict_languages, subwords, train_languages
from logmetrics.llm.toxicity import (
    _logistic,
    drop_toxic_rows,
    held_out,
    score_toxicity,
    segments,
    solve_lambda,
    train_toxicity,
)
from logmetrics.llm.words import text_buffers
from tests.llm.test_text import brute_contamination, brute_substrings

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SYLLABLES = {"aa": ["tha", "ing", "re", "of"], "bb": ["sch", "ung", "der", "ö"], "cc": ["ción", "ñ", "los", "que"]}


def prose(draw, lang, n):
    parts = SYLLABLES[lang]
    return " ".join("".join(draw.choice(parts, int(draw.integers(1, 4)))) for _ in range(n))


def language_rows():
    draw = np.random.default_rng(4)
    rows = []
    for k in range(400):
        lang = ["aa", "bb", "cc"][k % 3]
        rows.append((k, prose(draw, lang, int(draw.integers(3, 60))), lang if k % 11 else None, "s", 0))
    return rows


def test_subwords_do_not_cross_texts_or_words():
    data, offsets = text_buffers(pa.array(["ab, cd", "ab", None, "9 !", "cd"]))
    doc, row = subwords(data, offsets)
    assert set(doc.tolist()) == {0, 1, 4}
    alone = {k: set(row[doc == k].tolist()) for k in (1, 4)}
    assert len(alone[1]) == 3 and len(alone[4]) == 3  # a, b, ab
    assert alone[1] | alone[4] <= set(row[doc == 0].tolist())
    assert (subwords(*text_buffers(pa.array(["AB"])))[1] == row[doc == 1]).all()


def test_languages_of_held_out_rows(spark):
    rows = language_rows()
    odd = [(1000, None, None, "s", 0), (1001, "", None, "s", 0), (1002, "12 -- 7!", "aa", "s", 0), (None, "thaing", "aa", "s", 0),
           (1003, prose(np.random.default_rng(1), "bb", 60_000), None, "s", 0), (1004, "日本", None, "s", 0)]
    docs = spark.createDataFrame(rows + odd + rows[:2], DOCS).withColumn("lang_SCORE", F.lit("clash"))
    model = train_languages(docs)
    assert set(model.languages) == {"aa", "bb", "cc"}
    out = predict_languages(docs.drop("lang"), model).collect()
    assert len(out) == len(rows) + len(odd) + 2
    truth = {k: ["aa", "bb", "cc"][k % 3] for k in range(400)}
    far = [r for r in out if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(far) > 60 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in far]) > 0.97
    by_id = {r["doc_id"]: r for r in out}
    for k in (1000, 1001, 1002):
        assert (by_id[k]["lang_pred"], by_id[k]["lang_score"], by_id[k]["lang_rejected"]) == (UNKNOWN, 0.0, True)
    assert by_id[1003]["lang_pred"] == "bb" and by_id[1004]["lang_pred"] in model.languages
    assert all(0 <= r["lang_score"] <= 1 for r in out)
    again = predict_languages(docs.drop("lang"), train_languages(docs)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_languages_without_training(spark):
    docs = spark.createDataFrame([(1, "tha", None, "s", 0)], DOCS)
    assert predict_languages(docs, train_languages(docs)).first()["lang_pred"] == UNKNOWN
    model = train_languages(docs.limit(0))
    assert predict_languages(docs.limit(0), model).count() == 0


def brute_segments(scores):
    """All maximal segments by the definition: best span, then left and right of it."""
    best = None
    for b in range(len(scores)):
        for e in range(b + 1, len(scores) + 1):
            total = sum(scores[b:e])
            # Of equal sums the shortest, leftmost span.
            if total > 0 and (best is None or (total, b - e, -b) > (best[0], best[1] - best[2], -best[1])):
                best = (total, b, e)
    if best is None:
        return []
    _, b, e = best
    return brute_segments(scores[:b]) + [(b, e)] + [(e + x, e + y) for x, y in brute_segments(scores[e:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-3, 60), max_size=12))
def test_segments_against_the_definition(values):
    # Positive tokens get odd sizes so that no two spans tie; all others the same negative score.
    scores = [v + 0.01 * (k + 1) ** 2 if v > 0 else -7.3 for k, v in enumerate(values)]
    high = [k for k, s in enumerate(scores) if s > 0]
    got = segments(high, [scores[k] for k in high], -7.3)
    assert [(b, e) for b, e, _ in got] == brute_segments(scores)
    assert [s for _, _, s in got] == pytest.approx([sum(scores[b:e]) for b, e, _ in got])


def test_lambda_solves_its_equation():
    score, count = np.array([-0.1, 1.0, 3.0]), np.array([970, 20, 10])
    lam = solve_lambda(score, count)
    assert (count / 1000 * np.exp(lam * score)).sum() == pytest.approx(1, abs=1e-6) or lam == 1.0
    score, count = np.array([-0.1, 3.0]), np.array([999, 1])
    lam = solve_lambda(score, count)
    assert lam > 0 and (count / 1000 * np.exp(lam * score)).sum() == pytest.approx(1, abs=1e-6)
    assert solve_lambda(np.array([-1.0]), np.array([4])) == 1.0


@pytest.mark.parametrize("far", [1.0, 6.0, 60.0, 600.0])
def test_the_curve_separates(far):
    """Classes far apart must not throw the fit off."""
    draw = np.random.default_rng(0)
    x = np.r_[np.zeros(9000), far * 0.1 * draw.random(900), far * (0.9 + 0.2 * draw.random(1100))]
    y = np.r_[np.zeros(9900), np.ones(1100)]
    a, b = _logistic(x, y)
    p = 1 / (1 + np.exp(-(a + b * x)))
    assert ((p >= 0.7) == (y == 1)).mean() > 0.995


INSULTS = ["grub", "snot", "mulch"]


def toxic_rows():
    draw = np.random.default_rng(6)
    rows, labels = [], []
    for k in range(900):
        words = prose(draw, "aa", int(draw.integers(30, 200))).split()
        toxic = k % 6 == 0
        if toxic:
            for _ in range(int(draw.integers(3, 9))):
                word = str(draw.choice(INSULTS)) if k % 12 else "zork" + str(draw.choice(SYLLABLES["bb"]))
                words.insert(int(draw.integers(0, len(words))), word)
        rows.append((k, " ".join(words), "aa", "s", 0))
        labels.append((k, 1, int(toxic)))
    return rows, labels


LABELS = "doc_id bigint, quality int, toxic int"


def test_toxicity_of_held_out_rows(spark):
    rows, labels = toxic_rows()
    odd = [(2000, None, None, None, None), (2001, "", None, None, None), (None, "grub snot mulch grub", None, None, None),
           (2002, rows[1][1] + " GRUB, snot! mulch grub", None, None, None), (2003, prose(np.random.default_rng(2), "aa", 40_000), None, None, None)]
    docs = spark.createDataFrame(rows + odd + rows[:1], DOCS).withColumn("TOX_score", F.lit("clash"))
    more = [(None, 1, 1), (5, 1, None), (0, 1, 0), (0, 1, 1)]
    model = train_toxicity(docs, spark.createDataFrame(labels + more, LABELS))
    out = score_toxicity(docs.select("*", held_out().alias("far")), model).collect()
    truth = {k: t for k, _, t in labels}
    far = [r for r in out if r["far"] and r["doc_id"] in truth]
    assert len(far) > 200
    assert np.mean([r["tox_predicted"] == truth[r["doc_id"]] for r in far]) > 0.98
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[2000]["tox_score"] == by_id[2001]["tox_score"] < 0.2
    assert by_id[2002]["tox_predicted"] == 1 and by_id[2003]["tox_predicted"] == 0
    (passage,) = by_id[2002]["tox_passages"]
    n = len(rows[1][1].split())
    assert (passage["begin"], passage["end"]) == (n, n + 4) and passage["expected"] < 0.05
    kept = sorted(str(r["doc_id"]) for r in drop_toxic_rows(docs, model).collect())
    assert kept == sorted(str(r["doc_id"]) for r in out if r["tox_predicted"] == 0)


def test_clean_words_of_a_toxic_stem_do_not_score(spark):
    draw, rows, labels = np.random.default_rng(8), [], []
    for k in range(900):
        words = prose(draw, "aa", 60).split()
        if k % 6 == 0:
            words[5:5] = [f"zork{end}" for end in draw.choice(list("abcdefgh"), 4)]
        elif k % 30 == 1:
            words.insert(9, "zorkless")
        rows.append((k, " ".join(words), "aa", "s", 0))
        labels.append((k, 1, int(k % 6 == 0)))
    docs = spark.createDataFrame(rows, DOCS)
    model = train_toxicity(docs, spark.createDataFrame(labels, LABELS))
    odd = [(2000, "zorkless " * 6, None, None, None), (2001, "zorka " * 6, None, None, None)]
    out = {r["doc_id"]: r for r in score_toxicity(spark.createDataFrame(odd, DOCS), model).collect()}
    assert out[2000]["tox_predicted"] == 0 and not out[2000]["tox_passages"]
    assert out[2000]["tox_score"] < out[2001]["tox_score"] and out[2001]["tox_passages"]


def test_toxicity_without_training(spark):
    docs = spark.createDataFrame([(1, "grub", "aa", "s", 0)], DOCS)
    model = train_toxicity(docs, spark.createDataFrame([], LABELS))
    assert score_toxicity(docs, model).first()["tox_score"] < 0.01
    assert score_toxicity(docs.limit(0), model).count() == drop_toxic_rows(docs.limit(0), model).count() == 0


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage against what its own input asks for."""
    draw = np.random.default_rng(9)
    rows, labels = toxic_rows()
    item = prose(draw, "cc", 30)
    passage = prose(draw, "bb", 60)
    base = prose(draw, "bb", 300)
    rows += [(3000, base, "bb", "s", len(base)), (3001, base, "bb", "s", 1), (3002, base + " end", "bb", "s", 1)]
    rows += [(3003, prose(draw, "cc", 80) + " " + passage, "cc", None, None), (3004, passage + " " + prose(draw, "cc", 90), None, "s", 5)]
    rows += [(3005, item + " " + prose(draw, "cc", 20), "cc", "s", 3), (3006, None, None, None, None), (3007, "", "aa", "s", 0)]
    folder = tmp_path / "in"
    spark.createDataFrame(rows, DOCS).withColumn("extra", F.lit(1)).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(folder / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(folder / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(folder)).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "sentencepiece":
            assert out.columns == docs.columns
        seen.append({r["doc_id"]: r for r in out.collect()})
        docs = out
    toxic, near, passages, clean, pieces = seen
    truth = {k for k, _, t in labels if t}
    assert all(r[0] in toxic for r in rows if r[0] >= 3000)
    assert len(set(toxic) & truth) <= 4 and len({r[0] for r in rows} - set(toxic) - truth) <= 2
    assert {3000, 3003, 3006, 3007} <= set(near) and not {3001, 3002} & set(near)
    want = brute_substrings([(k, r["text"]) for k, r in near.items()])
    for k, r in passages.items():
        ((_, removed, kept),) = want[k]
        assert r["text"] == (kept if removed else near[k]["text"])
        assert r["n_chars"] == (len(kept) if removed else near[k]["n_chars"])
        assert tuple(r[c] for c in ("lang", "source", "extra")) == tuple(near[k][c] for c in ("lang", "source", "extra"))
    assert passages[3004]["text"] != near[3004]["text"]
    assert set(clean) == {k for k, r in passages.items() if not brute_contamination(r["text"], [(1, item)])[3]}
    assert 3005 not in clean and set(pieces) == set(clean)
    assert all(r["piece_text"] == (r["text"] or "") for r in pieces.values())
    whole = corpus_pipeline.run(spark, str(folder))
    assert sorted(r["doc_id"] for r in whole.collect()) == sorted(pieces)


def test_stages_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    for name, schema in (("labels", LABELS), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for stage in (stages.drop_toxic, stages.drop_near_copies, stages.drop_repeated_passages, stages.drop_contaminated, stages.encode_texts):
        assert stage(spark, docs, str(tmp_path)).count() == 0
