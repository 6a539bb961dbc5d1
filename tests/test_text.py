import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from logmetrics.functions.messages import tokenize_deleting_punctuation
from logmetrics.operators import embedding, text as t
from logmetrics.plans import jobs
from logmetrics.session import sized_broadcast

# The nine log lines of the clustering job.
LINES = [
    "localhost sshd Invalid user from port",
    "localhost sshd Received disconnect from port disconnected by user",
    "localhost sshd input_userauth_request:invalid user preauth",
    "localhost sshd Disconnected from port",
    "localhost sshd Connection closed by port preauth",
    "localhost sshd pam_unix session session closed for user ec2 user",
    "localhost sshd pam_unix session session opened for user ec2 user by uid",
    "localhost runuser pam_unix session session closed for user ec2 user",
    "localhost runuser pam_unix session session opened for user ec2 user by ec2 user uid",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(LINES)), "doc_id long, text string")


def python_terms(line, pairs=True):
    import re

    words = re.findall(r"\b\w\w+\b", line.lower())
    return words + ([f"{a} {b}" for a, b in zip(words, words[1:])] if pairs else [])


def test_tfidf_against_the_formula(spark, docs):
    counts = t.term_counts(docs)
    got = {(r["doc_id"], r["term"]): r["weight"] for r in t.tfidf(counts, F.lit(9)).collect()}
    terms = [python_terms(x) for x in LINES]
    df = {}
    for doc in terms:
        for term in set(doc):
            df[term] = df.get(term, 0) + 1
    want = {}
    for k, doc in enumerate(terms):
        raw = {x: doc.count(x) * (math.log(10 / (1 + df[x])) + 1) for x in doc}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        want.update({(k, x): v / norm for x, v in raw.items()})
    assert df["localhost"] == 9  # so its idf is exactly one
    assert got.keys() == want.keys()
    assert all(got[key] == pytest.approx(value) for key, value in want.items())


def test_vocabulary_is_in_code_point_order(docs):
    got = [r["term"] for r in t.vocabulary(t.term_counts(docs)).orderBy("term_id").collect()]
    assert got == sorted({x for line in LINES for x in python_terms(line)})


def test_bm25_floor(spark, docs):
    counts = t.term_counts(docs, tokens=tokenize_deleting_punctuation, pairs=False)
    idf = {r["term"]: (r["df"], r["idf"]) for r in t.bm25_idf(counts, F.lit(9)).collect()}
    raw = {x: math.log(9 - df + 0.5) - math.log(df + 0.5) for x, (df, _) in idf.items()}
    average = sum(raw.values()) / len(raw)
    assert raw["localhost"] < 0
    for term, (_, value) in idf.items():
        assert value == pytest.approx(raw[term] if raw[term] >= 0 else 0.25 * average)
    # The third line differs by a colon, which is deleted and not blanked.
    assert "inputuserauthrequestinvalid" in idf


def test_bm25_presence_ignores_repeats(spark, docs):
    counts = t.term_counts(docs, pairs=False)
    weights = t.bm25_presence(counts, t.bm25_idf(counts, F.lit(9)))
    session = {r["doc_id"]: r["weight"] for r in weights.filter("term = 'session'").collect()}
    assert set(session) == {5, 6, 7, 8} and len(set(session.values())) == 1


def test_feature_vectors_hold_the_weights(docs):
    counts = t.term_counts(docs)
    vocab = t.vocabulary(counts)
    vectors = t.to_feature_vector(t.tfidf(counts, F.lit(9), vocab), t.vocabulary_size(vocab))
    rows = vectors.select("doc_id", vector_to_array("features").alias("v")).collect()
    assert len(rows) == 9 and {len(r["v"]) for r in rows} == {vocab.count()}
    assert all(sum(x * x for x in r["v"]) == pytest.approx(1.0) for r in rows)


def test_document_length_and_size(docs):
    lengths = {r["doc_id"]: r["doc_len"] for r in t.document_length(docs).collect()}
    assert lengths == {k: len(python_terms(x, pairs=False)) for k, x in enumerate(LINES)}
    assert t.corpus_size(docs).first()["n"] == 9


def test_lemma_join_keeps_unknown_tokens(spark):
    tokens = spark.createDataFrame([(0, "users"), (1, "port")], "pos int, token string")
    lemmas = spark.createDataFrame([("users", "user")], "token string, lemma string")
    got = {r["pos"]: r["token"] for r in t.lemma_join(tokens, lemmas).collect()}
    assert got == {0: "user", 1: "port"}


VECTORS = [("disk", [1.0, 0.0]), ("full", [0.0, 2.0])]


@pytest.mark.parametrize(("combine", "first"), [("sqrtn", [2 / math.sqrt(3), 2 / math.sqrt(3)]),
                                                ("mean", [2 / 3, 2 / 3])])
@pytest.mark.parametrize("hinted", [True, False])
def test_embed_lookup(spark, combine, first, hinted):
    rows = spark.createDataFrame(
        [(0, "disk disk full unknown"), (1, "unknown"), (2, "disk disk full unknown"), (3, None)],
        "k long, message string",
    )
    vectors = spark.createDataFrame(VECTORS, "token string, vector array<double>")
    words = sized_broadcast(vectors) if hinted else vectors
    out = t.embed_lookup(rows, words, key="k", combine=combine)
    got = {r["k"]: r["features"] for r in out.collect()}
    assert got[0] == pytest.approx(first) and got[2] == got[0]
    assert got[1] is None and got[3] is None


def test_sized_broadcast_measures(spark):
    vectors = spark.createDataFrame(VECTORS, "token string, vector array<double>")
    joined = spark.createDataFrame([("disk",)], "token string")
    def hinted(table):
        plan = joined.join(table, "token")._jdf.queryExecution().analyzed().toString()
        return "hint" in plan.lower()
    assert hinted(sized_broadcast(vectors))
    assert not hinted(sized_broadcast(vectors, limit=10))


def test_embed_train(docs):
    model = embedding.embed_train(docs, size=4, min_count=1)
    table = embedding.word_table(model)
    assert table.filter("token = 'sshd' and size(vector) = 4").count() == 1
    embedded = embedding.EMBEDDINGS["word2vec"](docs, table, text="text")
    assert embedded.filter("size(features) = 4").count() == 9


@pytest.mark.parametrize("weighting", ["tfidf", "bm25"])
def test_log_clusters_labels_every_line(spark, docs, weighting):
    lemmas = spark.createDataFrame([("disconnected", "disconnect")], "token string, lemma string")
    got = jobs.log_clusters(docs, weighting=weighting, lemmas=lemmas).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(9))
    assert {r["cluster_label"] for r in got} <= set(range(6))


def test_terms_are_cut_in_pieces_of_bounded_text(spark, docs, monkeypatch):
    want = sorted(tuple(r) for r in t.term_counts(docs).collect())
    monkeypatch.setattr(t, "TEXT_BYTES", 4)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    cut = t.term_counts(docs)
    assert sorted(tuple(r) for r in cut.collect()) == want
    assert cut.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-total // 4))


def test_stored_counts_are_merged_in_pieces_of_bounded_rows(spark, monkeypatch):
    rows = [(d, w, 1) for d in (1, 2, None) for w in ("cats", "cat", "dog")]
    counts = spark.createDataFrame(rows, "doc_id long, term string, tf long")
    lemmas = F.broadcast(spark.createDataFrame([("cats", "cat")], "token string, lemma string"))
    monkeypatch.setattr(jobs, "COUNT_ROWS", 1)
    merged = jobs.lemma_counts(None, lemmas, counts=counts)
    assert merged.rdd.getNumPartitions() == max(9, spark.sparkContext.defaultParallelism)
    assert {tuple(r) for r in merged.collect()} == {(d, w, n) for d in (1, 2, None) for w, n in (("cat", 2), ("dog", 1))}


def test_a_text_is_known_by_the_bytes_of_its_hash(spark):
    vectors = spark.createDataFrame([("disk", [1.0, 2.0])], "token string, vector array<double>")
    rows = spark.createDataFrame([(1, "disk disk"), (2, "disk disk"), (3, None)], "doc_id long, message string")
    found = t.embed_lookup(rows, vectors, combine="mean")
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "unhex(sha2" in plan  # 32 bytes travel and not 64 letters
    assert [(r["doc_id"], r["features"]) for r in found.orderBy("doc_id").collect()] == [
        (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)]


def test_entries_of_sparse_vectors_come_back(spark):
    rows = spark.createDataFrame([(1, 4, 0.1), (1, 2, 1e-300), (None, 0, 3.0)], "doc_id long, term_id long, weight double")
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    vectors = t.to_feature_vector(rows, F.lit(9)).unionByName(t.to_feature_vector(rows, F.lit(9), docs=docs).where("doc_id = 2"))
    got = [tuple(r) for r in t.vector_entries(vectors).orderBy("doc_id", "term_id").collect()]
    assert got == [(None, 9, 0, 3.0), (1, 9, 2, 1e-300), (1, 9, 4, 0.1)]


@pytest.mark.parametrize("chunks", [None, 2, 5])
def test_tfidf_sends_terms_once_and_moves_no_counts(spark, monkeypatch, chunks):
    rows = [(k, line) for k, line in enumerate(LINES)] + [(3, "port Übung ß"), (None, "port port"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = t.term_counts(docs).collect()
    df = {}
    for r in plain:
        df[r["term"]] = df.get(r["term"], 0) + 1
    raw = {(r["doc_id"], r["term"]): (r["tf"], r["tf"] * (math.log(12 / (1 + df[r["term"]])) + 1)) for r in plain}
    norm = {d: math.sqrt(sum(w * w for (e, _), (_, w) in raw.items() if e == d)) for d, _ in raw}
    monkeypatch.setattr(t, "CHUNK_ROWS", 7)
    counts = t.term_counts(docs, chunks=chunks)
    found = t.tfidf(counts, docs.agg(F.count(F.lit(1))).scalar() - F.lit(1), chunks=chunks)
    got = {(r["doc_id"], r["term"]): (r["tf"], r["weight"]) for r in found.collect()}
    assert found.columns == ["doc_id", "term", "tf", "weight"] and found.count() == len(raw)
    assert got == {k: (tf, pytest.approx(w / norm[k[0]])) for k, (tf, w) in raw.items()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    # Only packed terms go by hash; before, terms and counts went there, and to their document.
    assert moved and all("_bucket" in x for x in moved)


def test_tfidf_of_no_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, "a")], "doc_id long, text string")
    assert t.tfidf(t.term_counts(docs, chunks=3), F.lit(2), chunks=3).collect() == []
    assert t.tfidf(t.term_counts(docs), F.lit(2)).collect() == []


def test_vectors_from_chunks_equal_joined_ones_and_move_no_rows(spark, capsys):
    """Terms go to their buckets, nothing is joined or sorted by document; a document may span batches."""
    lines = [(k, text) for k, text in enumerate([*LINES, None, "", "only once", LINES[0]])] + [(3, "two rows"), (None, "port user")]
    docs = spark.createDataFrame(lines, "doc_id long, text string")
    stored = t.term_counts(docs).localCheckpoint()
    terms = t.vocabulary(stored)
    joined = t.to_feature_vector(t.tfidf(stored, F.lit(13), terms), t.vocabulary_size(terms))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        counts = t.term_counts(docs, chunks=3)
        own = t.vocabulary(counts, 3)
        assert sorted(own.collect()) == sorted(terms.collect())
        weights = t.tfidf(counts, F.lit(13), own, chunks=3)
        vectors = t.to_feature_vector(weights, t.vocabulary_size(own), together=True)
        vectors.explain("simple")
        plan = capsys.readouterr().out
        assert "hashpartitioning(doc_id" not in plan and "hashpartitioning(term" not in plan
        got, want = ({r["doc_id"]: r["features"] for r in v.collect()} for v in (vectors, joined))
        some = t.tfidf(counts, F.lit(13), own.where("term <> 'port'"), chunks=3)  # a term that is not in the table
        fewer = {(r["doc_id"], r["term"]): r["weight"] for r in some.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() and len(got) == 12
    for doc, vector in want.items():
        assert got[doc].size == vector.size and got[doc].indices.tolist() == vector.indices.tolist()
        assert got[doc].values.tolist() == pytest.approx(vector.values.tolist())
    old = t.tfidf(stored, F.lit(13), terms.where("term <> 'port'")).collect()
    assert fewer == pytest.approx({(r["doc_id"], r["term"]): r["weight"] for r in old})
