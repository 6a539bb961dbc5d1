"""Queries over text features and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from logmetrics.functions import messages as m
from logmetrics.operators import cluster as k
from logmetrics.operators import cooccurrence as co
from logmetrics.operators import embedding as em
from logmetrics.operators import text as t
from logmetrics.plans import inputs as i
from logmetrics.plans import jobs
from logmetrics.plans.catalog import query
from logmetrics.session import materialize, sized_broadcast, spread


@query(f"""SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS token
FROM (SELECT doc_id, {i.SQL_WORDS} AS w FROM documents)""")
def tokenize_default(spark, sf_dir):
    return _positions(i.spread_documents(spark, sf_dir), m.tokenize_default)


@query(f"""SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS token
FROM (SELECT doc_id, {i.SQL_BARE_WORDS} AS w FROM documents)""")
def tokenize_deleting_punctuation(spark, sf_dir):
    return _positions(i.spread_documents(spark, sf_dir), m.tokenize_deleting_punctuation)


@query(f"""WITH w AS (SELECT doc_id, {i.SQL_WORDS} AS w FROM documents)
SELECT doc_id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS token,
       generate_subscripts(
         list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]), 1) - 1 AS pos
FROM w""")
def ngrams(spark, sf_dir):
    words = i.spread_documents(spark, sf_dir).select(
        "doc_id", m.tokenize_default(F.col("text")).alias("words")
    )
    return _numbered(words, m.ngrams(F.col("words")))


def _positions(docs, tokens):
    return _numbered(docs, tokens(F.col("text")))


def _numbered(rows, tokens):
    placed = rows.select("doc_id", F.posexplode(tokens).alias("pos", "token"))
    return placed.withColumn("pos", F.col("pos").cast("long"))


LEMMAS = f"""words AS (
  SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos
  FROM (SELECT doc_id, {i.SQL_BARE_WORDS} AS w FROM documents)),
lemmas AS (
  SELECT DISTINCT token, left(token, length(token) - 1) AS lemma FROM words
  WHERE token LIKE '%s' AND length(token) > 3)"""


@query(f"""WITH {LEMMAS}
SELECT doc_id, pos, coalesce(lemma, token) AS token FROM words LEFT JOIN lemmas USING (token)""")
def lemma_join(spark, sf_dir):
    tokens = _positions(i.spread_documents(spark, sf_dir), m.tokenize_deleting_punctuation)
    return t.lemma_join(tokens, _lemmas(tokens))


def _lemmas(tokens):
    """Words that end in s without it, as a table."""
    ending = F.col("token").endswith("s") & (F.length("token") > 3)
    lemmas = tokens.select("token").filter(ending).distinct().withColumn(
        "lemma", F.expr("left(token, length(token) - 1)")
    )
    return sized_broadcast(materialize(lemmas, "lemmas"))


def _words_once(spark, sf_dir):
    """(doc_id, term, tf) of words with punctuation deleted, written once, and their lemmas."""
    docs = i.documents(spark, sf_dir)
    counts = t.term_counts(docs, tokens=m.tokenize_deleting_punctuation, pairs=False)
    counts = materialize(counts, "words")
    return counts, _lemmas(counts.select(F.col("term").alias("token")))


def _lemma_counts(spark, sf_dir):
    counts, lemmas = _words_once(spark, sf_dir)
    return jobs.lemma_counts(None, lemmas, counts=counts)


def _counts(spark, sf_dir):
    return t.term_counts(i.documents(spark, sf_dir))


def _size(spark, sf_dir):
    return t.corpus_size(i.documents(spark, sf_dir)).scalar()


@query(f"WITH {i.TERMS} SELECT term, df FROM dfs")
def document_frequency(spark, sf_dir):
    return t.document_frequency(_counts(spark, sf_dir))


@query(f"""SELECT doc_id, len({i.SQL_WORDS}) AS doc_len,
  (SELECT count(DISTINCT doc_id) FROM documents) AS corpus_size FROM documents""")
def document_length(spark, sf_dir):
    lengths = t.document_length(i.documents(spark, sf_dir))
    return lengths.withColumn("corpus_size", _size(spark, sf_dir))


@query(f"""WITH {i.TERMS}
SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM dfs""")
def vocabulary(spark, sf_dir):
    return t.vocabulary(_counts(spark, sf_dir)).drop("df")


TFIDF = f"""{i.TERMS},
weighted AS (
  SELECT doc_id, term, tf, tf * (ln((1 + n) / (1.0::DOUBLE + df)) + 1) AS w
  FROM counts JOIN dfs USING (term), corpus),
tfidf AS (
  SELECT doc_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight
  FROM weighted)"""


@query(f"WITH {TFIDF} SELECT doc_id, term, tf, weight FROM tfidf")
def tfidf(spark, sf_dir):
    docs = i.documents(spark, sf_dir)
    chunks = t.text_chunks(docs)
    weights = t.tfidf(t.term_counts(docs, chunks=chunks), _size(spark, sf_dir), chunks=chunks)
    return weights.withColumn("weight", F.round("weight", 6))


BM25 = f"""{LEMMAS},
counts AS MATERIALIZED (
  SELECT DISTINCT doc_id, coalesce(lemma, token) AS term FROM words LEFT JOIN lemmas USING (token)),
dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM counts GROUP BY term),
corpus AS (SELECT count(*) AS n FROM documents),
raw AS MATERIALIZED (
  SELECT term, df, ln(n::DOUBLE - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw
  FROM dfs, corpus),
idfs AS (
  SELECT term, df,
    CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf
  FROM raw)"""


@query(f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM idfs")
def bm25_idf(spark, sf_dir):
    """Single words with punctuation deleted and lemmas applied."""
    idf = t.bm25_idf(_lemma_counts(spark, sf_dir), _size(spark, sf_dir))
    return idf.withColumn("idf", F.round("idf", 6))


@query(f"""WITH {BM25}
SELECT doc_id, term, round(idf, 6) AS weight FROM counts JOIN idfs USING (term)""")
def bm25_presence(spark, sf_dir):
    counts = materialize(_lemma_counts(spark, sf_dir), "counts")
    idf = t.bm25_idf(counts, _size(spark, sf_dir))
    return t.bm25_presence(counts, idf).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {TFIDF},
vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM dfs)
SELECT doc_id, (SELECT count(*) FROM vocab) AS size, term_id, weight
FROM tfidf JOIN vocab USING (term)""")
def feature_vectors(spark, sf_dir):
    docs = i.documents(spark, sf_dir)
    chunks = t.text_chunks(docs)
    counts = t.term_counts(docs, chunks=chunks)
    terms = t.vocabulary(counts, chunks)
    weights = t.tfidf(counts, _size(spark, sf_dir), terms, chunks=chunks)
    vectors = t.to_feature_vector(weights, t.vocabulary_size(terms), together=True)
    return t.vector_entries(vectors).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {i.LOGS}, {i.WORD_VECTORS},
used AS (
  SELECT seq, unnest(regexp_extract_all(lower(message), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS token
  FROM logs),
parts AS (
  SELECT seq, unnest(vector)::DOUBLE AS x, generate_subscripts(vector, 1) - 1 AS dim
  FROM used JOIN word_vectors USING (token))
SELECT seq, dim, round(sum(x) / sqrt(count(*)), 6) AS x FROM parts GROUP BY seq, dim""")
def embed_lookup(spark, sf_dir):
    rows = i.logs(spark, sf_dir).select("seq", "message")
    words = sized_broadcast(materialize(i.word_vectors(spark, sf_dir), "words"))
    embedded = t.embed_lookup(rows, words, key="seq")
    return embedded.select("seq", F.posexplode("features").alias("dim", "x")).select(
        "seq", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x")
    )


@query(f"""WITH w AS (SELECT doc_id, {i.SQL_WORDS} AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS token, len(w) AS n FROM w),
known AS (SELECT DISTINCT token FROM words WHERE n > 1)
SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM words JOIN known USING (token) WHERE words.doc_id = w.doc_id)
  THEN 16 END AS size FROM w""")
def embed_train(spark, sf_dir):
    """Vectors of all documents from the corpus' own word vectors: who has one, and of which size."""
    docs = i.documents(spark, sf_dir)
    table = materialize(co.embed_cooccurrence(docs, size=16), "words")
    embedded = t.embed_lookup(docs, sized_broadcast(table), key="doc_id", text="text", combine="mean")
    size = F.when(F.forall("features", lambda x: ~F.isnan(x)), F.size("features"))
    return embedded.select("doc_id", size.alias("size"))


@query()
def embed_train_word2vec(spark, sf_dir):
    docs = i.documents(spark, sf_dir)
    table = materialize(em.word_table(em.embed_train(docs, size=16, partitions=8)), "words")
    embedded = t.embed_lookup(docs, sized_broadcast(table), key="doc_id", text="text", combine="mean")
    return embedded.select("doc_id", "features")


# --- clusters ---------------------------------------------------------------

TYPES = ["click", "error", "purchase", "signup", "view"]


def _one_hot(spark, sf_dir):
    places = F.array(*[(F.col("event_type") == x).cast("double") for x in TYPES])
    points = i.events(spark, sf_dir).select("event_id", places.alias("features"))
    return spread(points, "event_id")


def _first_member(labelled):
    """Cluster ids depend on the start; the smallest member id does not."""
    firsts = labelled.groupBy("cluster_label").agg(F.min("event_id").alias("first_member"))
    return labelled.join(F.broadcast(firsts), "cluster_label")


@query("""SELECT event_id, min(event_id) OVER (PARTITION BY event_type) AS first_member
FROM events""")
def kmeans_fit_predict(spark, sf_dir):
    labelled = k.kmeans_fit_predict(_one_hot(spark, sf_dir), k=5, seeds=range(42, 46))
    return _first_member(labelled).select("event_id", "first_member")


@query("""SELECT min(event_id) OVER (PARTITION BY event_type) AS first_member, event_id
FROM events ORDER BY 1, 2""")
def sort_by_cluster(spark, sf_dir):
    points = _one_hot(spark, sf_dir)
    model = k.kmeans_fit(points, k=5, seeds=range(42, 46))
    labelled = k.attach_labels(points, model)
    firsts = _first_member(labelled).select(F.col("first_member").alias("cluster_label"), "event_id")
    return k.sort_by_cluster(firsts, "event_id").withColumnRenamed("cluster_label", "first_member")


@query("SELECT 0.0::DOUBLE AS inertia, count(*) AS rows FROM events")
def kmeans_inertia(spark, sf_dir):
    points = _one_hot(spark, sf_dir)
    cost = k.kmeans_inertia(k.kmeans_fit(points, k=5, seeds=range(4)))
    return points.agg(
        F.round(F.lit(float(cost)), 6).alias("inertia"), F.count(F.lit(1)).alias("rows")
    )


@query("""WITH x AS (
  SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings)
SELECT round(sum(ss), 6) AS inertia
FROM (SELECT dim, var_pop(x) * count(*) AS ss FROM x GROUP BY dim)""")
def total_inertia(spark, sf_dir):
    return k.total_inertia(i.vectors(spark, sf_dir)).select(F.round("inertia", 6).alias("inertia"))


@query()
def elbow(spark, sf_dir):
    return k.elbow(i.vectors(spark, sf_dir))


ASSIGN = """centres AS (
  SELECT label, unnest(embedding)::DOUBLE AS c, generate_subscripts(embedding, 1) AS dim
  FROM embeddings e JOIN (SELECT min(vec_id) AS vec_id FROM embeddings GROUP BY label)
    USING (vec_id)),
points AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim
  FROM embeddings),
distances AS (
  SELECT vec_id, label, sum((x - c) * (x - c)) AS d
  FROM points JOIN centres USING (dim) GROUP BY vec_id, label)"""


@query(f"""WITH {ASSIGN}
SELECT vec_id, arg_min(label, d)::BIGINT AS cluster_label, round(min(d), 6) AS distance
FROM distances GROUP BY vec_id""")
def kmeans_assign(spark, sf_dir):
    points = i.vectors(spark, sf_dir)
    # One centre per label: ten labels, whatever the number of points.
    firsts = points.groupBy("label").agg(F.min_by("features", "vec_id").alias("c")).collect()
    centres = [(r["label"], list(r["c"])) for r in firsts]
    return k.kmeans_assign(points.select("vec_id", "features"), centres).select(
        "vec_id", "cluster_label", F.round("distance", 6).alias("distance")
    )


@query()
def tfidf_clusters(spark, sf_dir):
    return jobs.log_clusters(i.documents(spark, sf_dir), weighting="tfidf", seeds=range(10))


@query()
def bm25_clusters(spark, sf_dir):
    counts, lemmas = _words_once(spark, sf_dir)
    return jobs.log_clusters(
        i.documents(spark, sf_dir), weighting="bm25", lemmas=lemmas, counts=counts, seeds=range(10)
    )


# Cleaned log messages repeat: one text per type, and none where the message is
# missing. With as many clusters as texts each text is a cluster, whatever the seed.
def _log_texts(spark, sf_dir):
    message = F.when(F.col("seq") % 7 != 0, m.clean_message(F.col("message")))
    return i.logs(spark, sf_dir).select(F.col("seq").alias("doc_id"), message.alias("text"))


def _text_clusters(spark, sf_dir, weighting):
    found = jobs.log_clusters(_log_texts(spark, sf_dir), weighting=weighting, k=6, seeds=range(3))
    firsts = found.groupBy("cluster_label").agg(F.min("doc_id").alias("first_member"))
    return found.join(F.broadcast(firsts), "cluster_label").select("doc_id", "first_member")


LOG_TEXTS = f"""WITH {i.LOGS},
texts AS (SELECT seq AS doc_id, CASE WHEN seq % 7 <> 0 THEN {i.sql_clean('message')} END AS text FROM logs)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_member FROM texts"""


@query(LOG_TEXTS)
def tfidf_log_clusters(spark, sf_dir):
    return _text_clusters(spark, sf_dir, "tfidf")


@query(LOG_TEXTS)
def bm25_log_clusters(spark, sf_dir):
    return _text_clusters(spark, sf_dir, "bm25")


@query("""WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
SELECT 1::BIGINT AS k, round(sum(n) - sum(n * n)::DOUBLE / sum(n), 6) AS inertia FROM c
UNION ALL SELECT 5, 0.0""")
def elbow_one_hot(spark, sf_dir):
    """One and five clusters of five points: the spread around the mean, and nothing."""
    found = k.elbow(_one_hot(spark, sf_dir), ks=(1, 5), starts=4, key="event_id")
    return found.withColumn("inertia", F.round("inertia", 6))


# Two vectors for all messages: errors have one word's, all others the other's.
@query(f"""WITH {i.LOGS},
frames AS (SELECT log_time AS time, arg_max(log_type, seq) AS log_type FROM logs GROUP BY log_time),
c AS (SELECT count(*) FILTER (log_type = 'error') AS a, count(*) FILTER (log_type <> 'error') AS b FROM frames)
SELECT k, CASE WHEN k = 1 THEN round(a * b / (a + b)::DOUBLE * 25, 6) ELSE 0.0 END AS inertia
FROM c, (SELECT unnest([1::BIGINT, 2, 3, 4]) AS k)""")
def log_elbow(spark, sf_dir):
    """Log messages cleaned, embedded and clustered, with one to four clusters."""
    words = [(w, [3.0, 4.0] if w == "error" else [0.0, 0.0]) for w in TYPES]
    vectors = spark.createDataFrame(words, "token string, vector array<double>")
    found = jobs.log_elbow(i.logs(spark, sf_dir), vectors)
    return found.withColumn("inertia", F.round("inertia", 6))
