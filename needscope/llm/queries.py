"""The dealt operators as registered queries over a folder of tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needscope.llm import (
    alignment, decontaminate, language, line_dedup, mixing, ngram_join, packing, secret_scan, spelling, top_k, toxicity, url_filter, warc,
)
from needscope.sources.readers import scan
from needscope.sources.scratch import scratch_dir, settle

# The rules that op9 judges by
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = scan(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.drop_recurring_lines(docs)


def op2_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_components(scan(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = f"{scratch_dir(spark)}/warc-{uuid4().hex}"
    warc.write_archives(scan(spark, folder, "pages"), archives)
    return warc.read_archives(spark, archives)


def op4_top_k(spark: SparkSession, folder: str) -> DataFrame:
    data = top_k.scaled_vectors(scan(spark, folder, "embeddings"), "vec_id", "embedding")
    return top_k.top_k(data.where("id % 100 = 0"), data)


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = scan(spark, folder, "documents")
    told = language.identify(docs, language.fit_languages(docs))
    return told.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan_secrets(scan(spark, folder, "documents"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(scan(spark, folder, "documents"), scan(spark, folder, "benchmark"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = scan(spark, folder, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, scan(spark, folder, "labels")))
    return scored.select("doc_id", language.held_out("doc_id").alias("held_out"), "score", "predicted")


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.filter_urls(scan(spark, folder, "pages"), url_filter.rule_table(spark, URL_RULES))


def op10_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(scan(spark, folder, "documents"))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(scan(spark, folder, "documents"))


def op12_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    cut = packing.pieces(scan(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    cut = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.place(settle(cut, "pieces"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    groups = F.col(alignment.GROUPS)
    digest = F.when(groups == "", "").otherwise(F.sha2(groups.cast("binary"), 256))
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_tokens(scan(spark, folder, "documents"), *paths, of_groups={"groups_sha256": digest})


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


OPERATORS = (
    op1_line_dedup, op2_ngram_jaccard_join, op3_warc, op4_top_k, op5_language_id, op6_secret_scan,
    op7_decontamination, op8_toxicity, op9_url_filter, op10_mix_sources, op11_spelling_variants,
    op12_best_fit_packing, op13_token_alignment, pipeline,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {build.__name__: build for build in OPERATORS}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SHINGLES = rf"""
words AS (
  SELECT {{id}} AS id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM {{table}}
), {{name}} AS (
  SELECT id, CASE
    WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
  END AS sh FROM words
)"""

ORACLE = {
    "op2_ngram_jaccard_join": "WITH RECURSIVE " + _SHINGLES.format(id="doc_id", table="documents", name="sets") + """,
    exploded AS (SELECT id, len(sh) AS n, unnest(sh) AS s FROM sets),
    pairs AS (
      SELECT a.id AS a, b.id AS b FROM exploded a JOIN exploded b ON a.s = b.s AND a.id < b.id
      GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
    ),
    links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
    reach AS (SELECT id AS a, id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT s.id AS doc_id, len(s.sh) AS n_shingles, min(r.b) AS component_id
    FROM sets s JOIN reach r ON r.a = s.id GROUP BY s.id, s.sh""",
    "op4_top_k": """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
      SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e, d.e)::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0
    ), ranked AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
    ) SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op3_warc": """
    WITH p AS (
      SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages
    ), s AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS last FROM p)
    SELECT page_id, n AS payload_bytes, digest AS payload_digest,
      CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to FROM s""",
    "op7_decontamination": "WITH " + _SHINGLES.format(id="doc_id", table="documents", name="sets")
    + ", " + _SHINGLES.format(id="item_id", table="benchmark", name="items").replace("words", "item_words") + """,
    i AS (SELECT items.id, least(len(w), 5) AS m, len(sh) AS n, unnest(sh) AS s FROM items JOIN item_words USING (id)),
    d AS (
      SELECT id, m, unnest(list_distinct(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i+m-1], ' ')))) AS s
      FROM words JOIN (SELECT DISTINCT m FROM i) ON len(w) >= m
    )
    SELECT d.id AS doc_id, i.id AS item_id, i.n AS item_shingles, count(*) AS shared
    FROM i JOIN d USING (m, s) GROUP BY d.id, i.id, i.n HAVING 100 * count(*) >= 80 * i.n""",
    "op11_spelling_variants": rf"""
    WITH RECURSIVE crc(step) AS (
      SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
        lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) ORDER BY i) FROM range(256) r(i)
    ), runs AS (
      SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]{{7,}}')) AS w FROM documents
    ), coded AS (SELECT w, hex(encode(concat(doc_id, ':', w))) AS x FROM runs
    ), hashed AS (
      SELECT w, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT,
        list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::UBIGINT)),
        lambda c, b: xor(c >> 8, step[((xor(c, b) & 255) + 1)::BIGINT]))) AS h FROM coded, crc
    ), cut AS (
      SELECT CASE WHEN h % 31 = 0 THEN left(w, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word FROM hashed
    ), words AS (SELECT word, count(*) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
    ), gaps AS (
      SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM words, unnest(range(length(word))) u(i)
    ), near AS (
      SELECT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.rest = w.word
      UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.rest = w.word
    ), best AS (
      SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
        row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM near
    ), told AS (
      SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form,
        CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
      FROM words w LEFT JOIN best b ON b.word = w.word AND place = 1
    ), steps(word, last, depth) AS (
      SELECT word, word, 0 FROM told
      UNION ALL SELECT s.word, t.form, depth + 1 FROM steps s JOIN told t ON t.word = s.last WHERE t.form IS NOT NULL
    ), roots AS (SELECT word, arg_max(last, depth) AS root FROM steps GROUP BY word)
    SELECT word, form, root, n::BIGINT AS n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM told JOIN roots USING (word)""",
    "op9_url_filter": rf"""
    WITH u AS (
      SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
    ), rules(h, p, verdict) AS (VALUES {', '.join(map(str, URL_RULES))}
    ), fit AS (
      SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
      FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
    )
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN fit USING (page_id)""",
}
