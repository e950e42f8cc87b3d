"""The operators over their given tables, with production parameters, as ``queries()`` registers them."""

import public_tokenizers
from pyspark.sql import functions as F

from airlattice.llm import ann, bpe, filter_audit, language, minhash, packing, quality, resampling, simhash, suffix_tree, token_counts, token_files, toxicity
from airlattice.llm.common import shared_folder, table

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_nearest(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 50 = 0")
    found = ann.nearest(vectors, "vec_id", "embedding", asked, 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _dot(a: str, b: str) -> str:
    return f"list_inner_product({a}.v, {b}.v)"


OP1_SQL = f"""
WITH usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, {_dot('q', 'c')} / (sqrt({_dot('q', 'q')}) * sqrt({_dot('c', 'c')})) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM pairs)
WHERE rank <= 5"""


def op2_packing(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))


def packed(docs):
    """The pieces' digests, numbered; the ids themselves stay where they were encoded."""
    found = packing.pieces(docs, public_tokenizers.path(WORD_BPE), end_id=1, max_length=2048)
    digests = found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.number_sequences(digests).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op3_quality(spark, sf_dir):
    found = quality.verdicts(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def op4_bpe(spark, sf_dir):
    path = public_tokenizers.path(BYTE_BPE)
    found = bpe.encode(table(spark, sf_dir, "documents"), path, decoded=True)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_token_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = shared_folder(spark, "token-files")
    token_files.write(docs, path, public_tokenizers.path(BYTE_BPE), end_id=0)
    return token_files.read_with_starts(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_token_counts(spark, sf_dir):
    found = token_counts.lengths(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return token_counts.histogram(found)


def op7_simhash(spark, sf_dir):
    found = simhash.near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op8_suffix_tree(spark, sf_dir):
    found = suffix_tree.held_out_scores(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_language(spark, sf_dir):
    return language.predicted(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_minhash(spark, sf_dir):
    found = minhash.near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def op12_filter_audit(spark, sf_dir):
    return filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# Each document against each order, as the question is put.
OP12_SQL = r"""
WITH cleaned AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
     100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'),
     coalesce(cleaned.doc_id > min(cleaned.doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM cleaned LEFT JOIN marks ON cleaned.doc_id = marks.doc_id),
counted AS (
  SELECT part, fails, count(*)::BIGINT AS docs, sum(good)::BIGINT AS good, sum(toxic)::BIGINT AS toxic FROM judged GROUP BY ALL),
f AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
taken AS (
  SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, f.i::INTEGER AS step,
    o[f.i] AS filter, docs, good, toxic, fails[o[f.i]] AS failing, len(list_filter(fails, lambda x: x)) = 1 AS single,
    len(list_filter(o[1:f.i - 1], lambda i: fails[i])) > 0 AS gone
  FROM counted, orders, f),
summed AS (
  SELECT part, filter_order, step, filter,
    coalesce(sum(docs) FILTER (NOT gone AND NOT failing), 0)::BIGINT AS kept,
    coalesce(sum(docs) FILTER (NOT gone AND failing), 0)::BIGINT AS removed,
    coalesce(sum(docs) FILTER (gone AND failing), 0)::BIGINT AS redundant,
    coalesce(sum(docs) FILTER (failing AND single), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND failing), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (NOT gone AND failing), 0)::BIGINT AS toxic_lost
  FROM taken GROUP BY ALL)
SELECT * EXCLUDE filter, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM summed"""


def op13_resampling(spark, sf_dir):
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# crc32 by its table of 256 values, once per distinct word.
OP13_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
corpus AS (
  SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
wanted AS (
  SELECT unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark),
held AS (SELECT row_no, unnest(words) AS word FROM corpus),
bucket_of AS (
  SELECT word, xor(list_reduce(list_concat([4294967295],
      list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::INT, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c & 255, b) + 1)::INT])), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM held UNION SELECT word FROM wanted), crc),
s AS (SELECT bucket, count(*) AS n FROM held JOIN bucket_of USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM wanted JOIN bucket_of USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM held) AS all_s, (SELECT count(*) FROM wanted) AS all_t),
gain AS (
  SELECT s.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1) * (all_s + 10000))::DOUBLE / ((s.n + 1) * (all_t + 10000))::DOUBLE))::BIGINT AS g
  FROM s LEFT JOIN t ON s.bucket = t.bucket, totals),
mean AS (SELECT row_no, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM held JOIN bucket_of USING (word) JOIN gain USING (bucket) GROUP BY row_no),
scored AS (
  SELECT doc_id, corpus.row_no, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256(concat('2024:', doc_id)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM corpus LEFT JOIN mean ON corpus.row_no = mean.row_no),
ranked AS (
  SELECT *, n_features >= 20 AS eligible,
    row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features DESC) AS place
  FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN eligible AND place <= 10 * (SELECT count(*) FROM ranked WHERE eligible) // 100 THEN place END AS rank
FROM ranked"""


QUERIES = {
    "op1_nearest": (op1_nearest, OP1_SQL),
    "op2_packing": (op2_packing, None),
    "op3_quality": (op3_quality, None),
    "op4_bpe": (op4_bpe, None),
    "op5_token_files": (op5_token_files, None),
    "op6_token_counts": (op6_token_counts, None),
    "op7_simhash": (op7_simhash, None),
    "op8_suffix_tree": (op8_suffix_tree, None),
    "op9_language": (op9_language, None),
    "op10_toxicity": (op10_toxicity, None),
    "op11_minhash": (op11_minhash, None),
    "op12_filter_audit": (op12_filter_audit, OP12_SQL),
    "op13_resampling": (op13_resampling, OP13_SQL),
}


def queries() -> dict:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
