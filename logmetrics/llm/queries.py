"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmetrics.llm.ann import search
from logmetrics.llm.catalog import query
from logmetrics.llm.chat import format_conversations, read_conversations
from logmetrics.llm.decontam import contamination, find_contamination
from logmetrics.llm.langid import held_out as lang_held_out
from logmetrics.llm.langid import predict_languages, train_languages
from logmetrics.llm.middle import move_middles, restore_texts
from logmetrics.llm.mix import mix_sources
from logmetrics.llm.neardup import near_duplicates
from logmetrics.llm.pieces import encode_pieces
from logmetrics.llm.resample import resample
from logmetrics.llm.sharding import shuffle_shards, text_bytes
from logmetrics.llm.substring import dedup_substrings
from logmetrics.llm.toxicity import held_out, score_toxicity, train_toxicity
from logmetrics.llm.warc import convert_arc, read_warc, write_arc
from logmetrics.session import materialize, sized_broadcast


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT r, doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13 AND doc_id IS NOT NULL)),
firsts AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g),
gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (g) WHERE first < doc_id),
words AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (r, p) GROUP BY r),
counts AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN counts USING (r) LEFT JOIN kept USING (r)
"""
)
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document after passages of earlier documents went."""
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, w, least(13, len(w)) AS size FROM b WHERE len(w) > 0),
grams AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS g
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM s)),
windows AS (
  SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM d, (SELECT DISTINCT size FROM s) WHERE len(w) >= size)),
hits AS (SELECT doc_id, i, windows.size AS size, item_id FROM windows JOIN grams USING (size, g)),
words AS (
  SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
)
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document stands in the benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(find_contamination(docs, table(spark, sf_dir, "benchmark")))
    ids = F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", "n_items", ids, "contaminated")


@query()
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = F.array_join(F.col("piece_ids").cast("array<string>"), " ")
    return encode_pieces(docs, keep_text=False).select(
        "doc_id",
        F.size("piece_ids").cast("bigint").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("piece_text", 256).alias("decoded_sha256"),
    )


@query()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    out = score_toxicity(docs, model)
    return out.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("tox_score").alias("score"),
        F.col("tox_predicted").alias("predicted"),
    )


@query()
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document after an external shuffle."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = shuffle_shards(docs, 24)
    return out.select(
        "doc_id",
        text_bytes("text").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


@query()
def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, F.col("id") % 50 == 0)


@query(
    r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  CAST(sum(14 + length(regexp_replace(role, '([\\#<:])', 'x\1', 'g'))
    + length(regexp_replace(text, '([\\#<])', 'x\1', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
)
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted by a template, read back and digested."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    out = read_conversations(format_conversations(turns.unionByName(more)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return out.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train_languages(docs)
    out = predict_languages(docs.select("doc_id", "text"), model, keep_text=False)
    return out.select(
        "doc_id",
        lang_held_out().alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_rejected").alias("rejected"),
    )


@query(
    """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS latest
  FROM pages),
b AS (
  SELECT *, list_transform(range(0, 8), lambda k: CAST('0x' || substr(hex, CAST(5 * k + 1 AS INTEGER), 5) AS INTEGER)) AS v FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((x >> s) & 31) + 1 AS INTEGER), 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = latest THEN NULL ELSE latest END AS refers_to
FROM b
"""
)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through legacy archives to WARC records, read back."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    records = materialize(read_warc(spark, convert_arc(spark, write_arc(pages))), "records")
    revisits, responses = records.where("refers_to IS NOT NULL"), records.where("refers_to IS NULL")
    # Only records that are referred to are looked up, one row each whatever the number of their copies.
    first = responses.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("first_page"))
    first = materialize(first.join(revisits.select("refers_to").distinct(), "refers_to", "left_semi"), "first")
    known = revisits.join(sized_broadcast(first), "refers_to", "left")
    out = known.unionByName(responses.withColumn("first_page", F.lit(None).cast("bigint")))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("first_page").alias("refers_to"))


@query(
    """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
h AS (
  SELECT *, CAST(length(text) AS BIGINT) AS n, CAST('0x' || substr(hex, 1, 8) AS BIGINT) AS h1,
    CAST('0x' || substr(hex, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(hex, 17, 8) AS BIGINT) AS h3,
    CAST('0x' || substr(hex, 25, 8) AS BIGINT) AS h4
  FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
         WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (SELECT *, substr(text, 1, a) AS pre, substr(text, a + 1, b - a) AS mid, substr(text, b + 1, n - b) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its middle moved to the end, and rebuilt from that."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = restore_texts(move_middles(docs, keep_text=False))
    return out.select(
        "doc_id",
        F.col("fim_units").alias("n"),
        F.col("fim_form").alias("form"),
        "prefix_chars",
        "middle_chars",
        F.sha2("fim_text", 256).alias("output_sha256"),
        F.sha2("restored_text", 256).alias("restored_sha256"),
    )


@query(
    r"""
WITH RECURSIVE steps AS (
  SELECT i, i::UBIGINT AS v, 0 AS step FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, step + 1 FROM steps WHERE step < 8),
tab AS (SELECT list(v ORDER BY i) AS tab FROM steps WHERE step = 8),
texts AS (
  SELECT row_number() OVER () AS r, * FROM
    (SELECT 0 AS part, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark)),
cut AS (
  SELECT r, part, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS (
  SELECT r, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM cut, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
counted AS MATERIALIZED (SELECT r, g, count(*) AS n FROM grams GROUP BY r, g),
features AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM counted)),
hashed AS MATERIALIZED (
  SELECT g, xor(list_reduce(
      list_prepend(4294967295::UBIGINT, list_transform(range(1, length(h)::BIGINT, 2), lambda k: ('0x' || substr(h, k::BIGINT, 2))::UBIGINT)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 10000 AS bucket
  FROM features, tab),
sums AS MATERIALIZED (
  SELECT r, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (g) GROUP BY r, bucket),
sides AS (
  SELECT bucket, coalesce(sum(n) FILTER (part = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (part = 1), 0)::DOUBLE AS t
  FROM sums JOIN cut USING (r) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sides) + 10000)
    / ((s + 1) * ((SELECT sum(t) FROM sides) + 10000))))::BIGINT AS gain FROM sides),
weights AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM sums JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
      + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM cut LEFT JOIN weights USING (r) WHERE part = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, weight, n_features, n_words) AS place
  FROM scored)
SELECT doc_id, n_features, weight, score, n_words,
  CASE WHEN n_words >= 20 AND place <= 5 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100 THEN place END AS rank
FROM ranked
"""
)
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A twentieth of the documents drawn towards the benchmark's n-grams."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = resample(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


@query(
    r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    sha256('23:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS hash
  FROM documents),
p AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY hash, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nr
  FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][nr % 3 + 1] AS weight FROM s),
sums AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
    coalesce(sum(3 * source_size) OVER low, 0) AS held, coalesce(sum(weight) OVER low, 0) AS gone
  FROM w WINDOW low AS (ORDER BY 3 * source_size / weight, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, weight * (total - held) > 3 * source_size * (weights - gone) AS is_full FROM sums),
l AS (
  SELECT any_value(total) AS total, any_value(total) - coalesce(sum(3 * source_size) FILTER (is_full), 0) AS words,
    any_value(weights) - coalesce(sum(weight) FILTER (is_full), 0) AS shares,
    greatest(1, least(1024, coalesce(min(source_size) FILTER (source_size > 0), 1) // 256)) AS block
  FROM f),
t AS (
  SELECT nr, source, source_size, total, block,
    least(CAST(weight * words AS DOUBLE) / CAST(shares AS DOUBLE), CAST(3 * source_size AS DOUBLE)) AS target
  FROM w, l),
seats AS (
  SELECT nr, total, block, row_number() OVER (ORDER BY target / (2 * seat + 1) DESC, nr, seat) AS place
  FROM (SELECT *, unnest(range(0, 3 * source_size // block + 2)) AS seat FROM t WHERE target > 0)),
q AS (SELECT nr, count(*) AS seats FROM seats WHERE place <= (total + block // 2) // block GROUP BY nr),
m AS (SELECT t.*, least(coalesce(seats, 0) * block, 3 * source_size) AS taken_words FROM t LEFT JOIN q USING (nr))
SELECT doc_id, size, source_size, target, CAST(
    greatest(0, least(before + size, taken_words) - before)
  + greatest(0, least(before + source_size + size, taken_words) - before - source_size)
  + greatest(0, least(before + 2 * source_size + size, taken_words) - before - 2 * source_size) AS BIGINT) AS taken
FROM p JOIN m ON p.source IS NOT DISTINCT FROM m.source
"""
)
def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix of all sources takes."""
    out = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")
