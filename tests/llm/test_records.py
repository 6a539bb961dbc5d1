"""Shards, vectors, conversations, pieces and archives: laws, brute force and round trips."""

import hashlib
import sys
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logmetrics.llm.ann import cosines, encode, estimates, search
from logmetrics.llm.chat import FILTERS, TEMPLATE, format_conversations, read_conversations, read_turns
from logmetrics.llm import pieces
from logmetrics.llm.pieces import Codec, decode_pieces, default_model, encode_pieces
from logmetrics.llm.sharding import shuffle_shards
from logmetrics.llm.template import TemplateError, compile_template, fold, parse
from logmetrics.llm.warc import (
    arc_record,
    arc_start,
    convert_arc,
    digest32,
    files,
    read_arc_bytes,
    read_warc,
    read_warc_bytes,
    write_arc,
)

DOCS = "doc_id bigint, text string"


def stored(spark, tmp_path, rows, schema, parts=3):
    path = str(tmp_path / hashlib.md5(repr(rows).encode()).hexdigest())
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


def shard_rows():
    rows = [(k, "t" * (k % 90)) for k in range(400)]
    return rows + [(None, "x"), (None, None), (7, None), (8, "")] + [(5, "same")] * 150


def test_shards(spark, tmp_path):
    rows = shard_rows()
    docs = stored(spark, tmp_path, rows, DOCS).withColumn("Slot", F.lit("clash")).withColumn("tag", F.lit("t"))
    out = shuffle_shards(docs, 5, bucket_bytes=600).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    assert sorted([(r["doc_id"], r["text"]) for r in out], key=key) == sorted(rows, key=key)
    for shard in range(5):
        slots = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert slots == list(range(len(slots))) and slots
    assert all(r["tag"] == "t" for r in out)
    by_key = {}
    for r in out:
        assert by_key.setdefault(r["doc_id"], r["shard"]) == r["shard"]
        assert r["grown_shard"] in (r["shard"], 5)
    grown = {r["doc_id"]: r["shard"] for r in shuffle_shards(docs, 6, bucket_bytes=600).collect()}
    assert all(r["grown_shard"] == grown[r["doc_id"]] for r in out)
    again = shuffle_shards(docs, 5, bucket_bytes=600)
    assert sorted(map(str, again.collect())) == sorted(map(str, out))
    ordered = [r["doc_id"] for r in sorted(out, key=lambda r: r["slot"]) if r["shard"] == 0 and r["doc_id"] is not None]
    assert ordered != sorted(ordered)


def test_shards_of_nothing(spark, tmp_path):
    assert shuffle_shards(stored(spark, tmp_path, [], DOCS, 1), 3).count() == 0


def test_estimates_keep_their_bounds():
    draw = np.random.default_rng(1)
    vectors, queries = draw.standard_normal((3000, 64)), draw.standard_normal((40, 64))
    codes, scalars = encode(vectors)
    guess, error = estimates(queries, codes, scalars, 64)
    true = queries @ vectors.T / np.outer(np.linalg.norm(queries, axis=1), np.linalg.norm(vectors, axis=1))
    assert (np.abs(guess - true) <= error).mean() > 0.99
    assert abs((guess - true).mean()) < 0.01
    assert cosines(np.array([[1e200, 0.0]]), np.array([[1e-200, 1e-200]]))[0] == pytest.approx(0.5**0.5)


@pytest.mark.parametrize(("dim", "n"), [(20, 700), (64, 900), (1, 30)])
def test_search_recall(spark, dim, n):
    draw = np.random.default_rng(dim)
    vectors = draw.standard_normal((n, dim)).astype(np.float32)
    vectors[n // 2 : n // 2 + 10] = vectors[min(50, n - 1)]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    rows += [(50_000, None), (50_050, [0.0] * dim), (50_100, [float("nan")] * dim), (50_150, [None] * dim)]
    rows += [(None, [1.0] * dim), (60_000, [1.0] * (dim + 3)), (70_000, [float("inf")] * dim)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("rank", F.lit(0))
    out = search(frame, F.col("id") % 50 == 0, query_rows=8, vector_rows=128).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, n, 50):
        score = unit @ unit[q]
        score[q] = -9
        best = np.lexsort((np.arange(n), -np.round(score, 9)))[:5]
        ranks, ids, scores = zip(*got[q])
        assert ranks == (1, 2, 3, 4, 5) and list(scores) == sorted(scores, reverse=True)
        assert scores == pytest.approx(score[list(ids)])
        hits += sum(s >= score[best[-1]] - 1e-9 for s in scores)
        total += 5
    assert hits / total >= 0.98
    assert set(got) == set(range(0, n, 50))


def test_search_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert search(empty, F.col("id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in search(few, F.col("id") == 0).collect()] == [(0, 1, 1)]


def test_templates():
    run = compile_template("{# no #}{% set a = 'x' + 'y' %}{% for t in ts %}{{ loop.index }}{{ t['k'] | up }}"
                           "{% if loop.last %}.{% elif t.k == 'b' %}!{% else %},{% endif %}{% endfor %}{{ a }}",
                           {"up": str.upper})
    assert run({"ts": [{"k": "a"}, {"k": "b"}, {"k": "c"}]}) == ("1A,2B!3C.xy", [])
    tree = fold(parse("a{{ 'b' | up }}{% if 1 < 2 and not false %}c{% else %}{{ gone }}{% endif %}d"), {"up": str.upper})
    assert [n.kind for n in tree.children] == ["print"] and tree.children[0].children[0].value == "aBcd"
    text, marks = compile_template("x{% generation %}{{ t }}{% endgeneration %}y")({"t": "one"})
    assert (text, marks) == ("xoney", [(1, 4)])


@pytest.mark.parametrize("source", [
    "{{ a() }}", "{% for x in y %}", "{{ 'a' | nofilter }}", "{% while x %}", "{{ a b }}", "{{ ; }}", "{{ and }}",
])
def test_bad_templates(source):
    with pytest.raises(TemplateError):
        compile_template(source)


@pytest.mark.parametrize("source", ["{{ x.__class__ }}", "{{ gone }}", "{{ x['k'] }}", "{{ x + 1 }}"])
def test_the_sandbox(source):
    with pytest.raises(TemplateError):
        compile_template(source)({"x": "text"})


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="usr:\\#< ", max_size=6), st.text(alphabet="a\\#<>/turn:\n é", max_size=25)), max_size=4))
def test_turns_round_trip(turns):
    rows = [{"role": r, "text": t} for r, t in turns]
    text, _ = compile_template(TEMPLATE, FILTERS)({"turns": rows})
    assert read_turns(text) == rows


def test_conversations(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", said), (1, 0, "user", said), (2, None, None, None), (2, 3, "assistant", "b"),
            (2, 3, "assistant", "a"), (2, 3, "assistant", "a"), (None, 0, "user", "x" * 50_000)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = {r["conv_id"]: r for r in read_conversations(format_conversations(frame.withColumn("turns", F.lit(1)))).collect()}
    assert [tuple(t) for t in out[1]["turns"]] == [("user", said), ("assistant", said)]
    assert out[1]["loss_texts"] == [said]
    assert out[1]["formatted"].count("</turn>\n") == 2
    assert [tuple(t) for t in out[2]["turns"]] == [("", ""), *[("assistant", t) for t in "aab"]]
    assert len(out[None]["turns"][0]["text"]) == 50_000
    assert format_conversations(frame.limit(0)).count() == 0


PIECE_TEXTS = ["", " ", "  a  b ", "a\nb", "\n\n x", "a▁b", "\x00a", "é\xa0ﬁ", "\t\ta", "日本語😀 \U0010ffff", "<s> x</s>",
               "foo.\nBar baz\r\n", "a" * 300, " " * 70, "The the THE the.", "\n", "x \n y", "١٢٣ नमस्ते"]


@pytest.fixture(scope="module")
def codec():
    with open(default_model(), "rb") as file:
        return Codec(file.read())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40))
def test_pieces_are_the_librarys(codec, text):
    ids, back = codec.encode([text])
    want = codec.library.encode(text, add_eos=True)
    assert np.frombuffer(ids[0], np.int32).tolist() == want
    assert back[0] == codec.library.decode(want) == codec.decode(want)


def test_rows_merge_like_the_agenda(codec):
    draw = np.random.default_rng(6)
    letters = list("▁abethionrs日é") + ["th", "▁the", "ing", "\U00010378"]
    segments = ["".join(draw.choice(letters, int(draw.integers(1, 40)))).replace("\n", "") for _ in range(400)] + ["\n", "▁"]
    found, spelled = codec.merge_all(segments)
    assert [np.frombuffer(f, np.int32).tolist() for f in found] == [codec.merge(s) for s in segments]
    assert {k for k, s in enumerate(segments) if "\U00010378" in s} <= set(spelled)


def test_the_librarys_pieces_are_taken_where_ours_differ(codec, monkeypatch):
    with open(default_model(), "rb") as file:
        fresh = Codec(file.read())
    wrong = fresh.merge_all
    monkeypatch.setattr(fresh, "merge_all", lambda s: ([b"" if k % 3 else f for k, f in enumerate(wrong(s)[0])], []))
    text = "some plain words\n here  and ther\U00010378e"
    ids, back = fresh.encode([text])
    want = fresh.library.encode(text, add_eos=True)
    assert np.frombuffer(ids[0], np.int32).tolist() == want and back[0] == fresh.library.decode(want)
    assert fresh.mismatches > 0 and codec.mismatches == 0


def test_pieces_frame(spark):
    rows = list(enumerate([*PIECE_TEXTS, None, PIECE_TEXTS[2], "word " * 30_000]))
    docs = spark.createDataFrame(rows, DOCS).withColumn("Piece_ids", F.lit(0))
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    out = encode_pieces(docs)
    for r in decode_pieces(out.withColumnRenamed("piece_text", "first")).collect():
        want = library.encode(rows[r["doc_id"]][1] or "", add_eos=True)
        assert r["piece_ids"] == want
        assert r["first"] == r["piece_text"] == library.decode(want)
    assert encode_pieces(docs.limit(0)).count() == 0


def test_arc_versions():
    for version in (1, 2):
        block = b"HTTP/1.1 200 OK\r\nX-Page-Id: 3\r\n\r\nbody\n\n"
        data = arc_start(version, "a.arc") + b"\n" + arc_record(version, "http://x/a b", block, "a.arc") + b"\n"
        ((_, fields, got),) = list(read_arc_bytes(data))
        assert got == block and fields["URL"] == "http://x/a%20b" and fields["Archive-date"] == "20240101000000"
        with pytest.raises(ValueError):
            list(read_arc_bytes(data[:-8]))
    with pytest.raises(ValueError):
        list(read_arc_bytes(b"http://x 0 0 0 0\n"))


def test_archives(spark, tmp_path):
    pages = [(k, f"http://h/{k}", "<p>é\r\n\r\n" + "x\n" * (k % 7)) for k in range(60)]
    pages += [(100, None, None), (101, "http://h/ e", ""), (102, "http://h/big", "y" * 400_000), (7, "http://h/7", pages[7][2])]
    pages += [(None, "http://h/n", "only one"), (None, None, "")]
    frame = stored(spark, tmp_path, pages, "page_id bigint, url string, html string").withColumn("path", F.lit(1))
    arcs = write_arc(frame, archive_bytes=4000)
    assert files(spark, arcs).count() > 3
    warcs = convert_arc(spark, arcs)
    out = read_warc(spark, warcs).collect()
    assert sum(len(list(read_warc_bytes(bytes(r["content"])))) for r in files(spark, warcs).collect()) == len(pages)
    assert len({r["record_id"] for r in out}) == len(pages)
    got = sorted((r["page_id"] is not None, r["page_id"] or 0, r["payload_digest"], r["payload_bytes"]) for r in out)
    want = [(i is not None, i or 0, digest32((h or "").encode()), len((h or "").encode())) for i, _, h in pages]
    assert got == sorted(want)
    page_of = {r["record_id"]: r["page_id"] for r in out}
    for digest in {r["payload_digest"] for r in out}:
        same = [r for r in out if r["payload_digest"] == digest]
        (first,) = [r for r in same if r["record_type"] == "response"]
        assert first["refers_to"] is None
        assert (first["page_id"] or -1) == max(r["page_id"] if r["page_id"] is not None else -1 for r in same)
        assert all(r["refers_to"] == first["record_id"] for r in same if r is not first)
        assert page_of[first["record_id"]] == first["page_id"]
    shorter = read_warc(spark, convert_arc(spark, arcs, least=1)).collect()
    assert all(r["record_type"] == "response" for r in shorter if r["payload_bytes"] == 0)


def test_archives_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert read_warc(spark, convert_arc(spark, write_arc(empty))).count() == 0


def test_checksums_are_unsigned(spark):
    frame = spark.createDataFrame([("é",)], "t string").select(F.crc32(F.col("t").cast("binary")).alias("c"))
    assert frame.first()["c"] == zlib.crc32("é".encode())


def test_kept_segments_stay_small():
    with open(default_model(), "rb") as file:
        codec = Codec(file.read())
    codec.encode([" ".join(f"seg{k}ment" for k in range(20_000))])
    each = sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in codec.kept.items()) / len(codec.kept)
    # A worker keeps them after its stage, beside the memory that later stages need.
    assert pieces.KEPT * each < 80e6
