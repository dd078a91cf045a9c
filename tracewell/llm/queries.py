"""One query per operator, over its whole table, and SQL for those that SQL can express."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import (
    byte_bpe, lexical_search, line_crf, neighbours, packing, quality, secret_scan, shared, shingle_join, substring_dedup, suffix_tree, token_files, url_rules,
    vector_codes)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(run: Query) -> Query:
        def configured(spark: SparkSession, folder: str) -> DataFrame:
            return run(shared.configure(spark), folder)
        QUERIES[name] = configured
        if oracle is not None:
            ORACLES[name] = oracle
        return run
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc32_of(ids: str) -> F.Column:
    return F.crc32(F.col(ids)).cast("bigint")


# ------------------------------------------------------------------ URL filter

# fixed values of the contract
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block"))

URL_SQL = """
WITH rules(rhost, rpath, verdict) AS (VALUES %s),
p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
hits AS (
  SELECT DISTINCT host, path, rhost || rpath AS rule, verdict
  FROM (SELECT DISTINCT host, path FROM p)
  JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
best AS (
  SELECT host, path, rule, verdict FROM hits
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC) = 1)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN best ON p.host = best.host AND p.path = best.path
""" % ", ".join(str(r) for r in URL_RULES)


@query("op3_url_filter", URL_SQL)
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, folder, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


# ------------------------------------------------------------------ tokens

@query("op6_packing")
def pack(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, length=2048, special=True)
    return pieces.select("doc_id", "start", "length", crc32_of("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op7_byte_bpe")
def byte_level(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, folder, "documents"), vocabulary)
    return byte_bpe.decode(encoded, vocabulary).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_token_files")
def files_of_ids(spark: SparkSession, folder: str) -> DataFrame:
    parts = token_files.write(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, special=True)
    return token_files.read(parts).select("doc_id", "start", "n_tokens", crc32_of("ids").alias("ids_crc32"))


# ------------------------------------------------------------------ quality

@query("op5_quality_rules")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.train(docs, table(spark, folder, "labels"))
    return quality.score(docs, model).select("doc_id", *quality.COUNTS, "base_failed", "kept")


def held_out(doc_id: str, modulus: int, remainder: int) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))


@query("op8_line_crf")
def line_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = line_crf.train(docs, table(spark, folder, "labels"), allowed=~held_out("doc_id", 5, 0))
    return line_crf.score(docs, model).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score",
        (F.col("score") >= line_crf.THRESHOLD).cast("int").alias("predicted"))


# ------------------------------------------------------------------ near duplicates

@query("op4_shingle_join")
def similar_documents(spark: SparkSession, folder: str) -> DataFrame:
    return shingle_join.join(table(spark, folder, "documents"), width=3, percent=90).select("doc_id", "n_shingles", "component_id")


@query("op10_substring_dedup")
def repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return substring_dedup.remove(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


# ------------------------------------------------------------------ language model

@query("op2_suffix_tree")
def suffix_tree_scores(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_tree.score(table(spark, folder, "documents"), modulus=7, remainder=2)


# ------------------------------------------------------------------ nearest neighbours

@query("op1_nn_descent")
def nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    index = neighbours.build(vectors)
    return neighbours.search(index, vectors.where("vec_id % 50 = 0"), k=5).withColumnRenamed("id", "vec_id")


# ------------------------------------------------------------------ secrets

def listed(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op11_secret_scan")
def secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(table(spark, folder, "documents").select("doc_id", "text"))
    spans = F.col("spans")

    def of(*kinds: str) -> F.Column:
        return F.filter(spans, lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(kind)).cast("bigint").alias(f"n_{kind}") for kind in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(listed(of(*secret_scan.BASE)).cast("binary"), 256).alias("base_sha256"), listed(spans).alias("spans"))


# ------------------------------------------------------------------ ranked search

SEARCH_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, terms FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents)
  WHERE len(terms) > 0),
asked AS (
  SELECT i, item_id, term, count(*) AS repeats FROM (
    SELECT i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark))
  GROUP BY i, item_id, term),
stats AS (SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS total FROM docs),
tf AS (
  SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY d, term),
weight AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), stats),
gain AS (
  SELECT d, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(terms)::BIGINT * docs) // total)) AS gain
  FROM tf JOIN docs USING (d), stats),
scored AS (
  SELECT i, item_id, d, doc_id, sum(w * repeats * gain)::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN gain USING (term) GROUP BY i, item_id, d, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, d) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""


@query("op12_lexical_search", SEARCH_SQL)
def ranked(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


# ------------------------------------------------------------------ vector codes

_NEAREST = """
a{n} AS (SELECT r, p, entry, gap FROM (
    SELECT r, p, entry, sum((x - c) * (x - c))::BIGINT AS gap FROM x JOIN b{n} USING (p, j) GROUP BY r, p, entry)
  QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY gap, entry) = 1),"""
_MOVED = """
b{m} AS (SELECT p, entry, j, coalesce(moved, c) AS c FROM b{n} LEFT JOIN (
    SELECT p, entry, j, floor(sum(x)::DOUBLE / count(*))::BIGINT AS moved FROM x JOIN a{n} USING (r, p) GROUP BY p, entry, j) USING (p, entry, j)),"""

CODES_SQL = """
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS (
  SELECT r, (i - 1) // (n // 16) AS p, (i - 1) % (n // 16) AS j, floor(256 * e::DOUBLE)::BIGINT AS x
  FROM (SELECT r, unnest(v) AS e, generate_subscripts(v, 1) AS i, len(v) AS n FROM k)),
b0 AS (SELECT p, r AS entry, j, x AS c FROM x WHERE r < 64),""" + (
    _NEAREST.format(n=0) + _MOVED.format(n=0, m=1) + _NEAREST.format(n=1) + _MOVED.format(n=1, m=2) + _NEAREST.format(n=2)) + """
coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, sum(gap)::BIGINT AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, entry, j)) FROM b2) AS codebooks_sha256
FROM coded JOIN k USING (r)
"""


@query("op13_vector_codes", CODES_SQL)
def vector_compression(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, folder, "embeddings"))
    return coded.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))
