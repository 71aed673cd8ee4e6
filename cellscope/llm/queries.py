"""The registered queries of the training-data operators: each over its whole tables, with its contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, langid, mixing, packing, periodic, pii, quality_model, quality_rules, simhash, substrings, topk, url_filters, vector_codes
from ._common import documents

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _remainder(column: str, n: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.stored(topk.integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    return topk.topk(vectors.filter("vec_id % 20 = 0"), vectors, 20)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(documents(spark, sf_dir), size=3, bits=64, distance=2)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.train(docs.filter(_remainder("doc_id", 4) != 2))
    held = F.coalesce(_remainder("doc_id", 4) == 2, F.lit(False))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_model.train(docs, labels.select("doc_id", "quality").filter(_remainder("doc_id", 3) != 1))
    held = F.coalesce(_remainder("doc_id", 3) == 1, F.lit(False))
    return quality_model.predict(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), TOKENIZER)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(documents(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(documents(spark, sf_dir), plant=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_exact_topk, op2_html_text, op3_simhash, op4_mixing, op5_quality_rules, op6_language_id, op7_url_filters, op8_quality_model, op9_pii, op10_packing,
           op11_substring_dedup, op12_vector_codes, op13_periodic_runs)
    return {f.__name__: f for f in own}


_LEVEL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM per_source
), ordered AS (
  SELECT *, row_number() OVER o AS place,
    (SELECT sum(source_size) FROM per_source)::BIGINT - coalesce(sum(3 * source_size) OVER b, 0)::BIGINT AS tokens,
    sum(w) OVER ()::BIGINT - coalesce(sum(w) OVER b, 0)::BIGINT AS weights
  FROM ranked
  WINDOW o AS (ORDER BY 3 * source_size::DOUBLE / w, source NULLS LAST), b AS (ORDER BY 3 * source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT place, tokens, weights FROM ordered WHERE tokens * w <= 3 * source_size * weights ORDER BY place LIMIT 1
), targets AS (
  SELECT o.source, o.source_size,
    CASE WHEN l.place IS NULL OR o.place < l.place THEN (3 * o.source_size)::DOUBLE ELSE (o.w * l.tokens)::DOUBLE / l.weights END AS target
  FROM ordered o LEFT JOIN level l ON true
), rated AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5(concat_ws(':', coalesce(s.doc_id::VARCHAR, ''), '17')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), parts AS (
  SELECT *, floor(rate)::BIGINT AS whole, rate - floor(rate) AS fraction, size * 25 > source_size AS large FROM rated
), wanted AS (
  SELECT source, any_value(target) - any_value(whole) * any_value(source_size) - coalesce(sum(size) FILTER (WHERE large AND draw < fraction), 0)::BIGINT AS want,
    coalesce(sum(size) FILTER (WHERE NOT large), 0)::BIGINT AS small FROM parts GROUP BY source
), steps AS (
  SELECT source, draw, sum(sum(size)) OVER (PARTITION BY source ORDER BY draw)::BIGINT AS upto FROM parts WHERE NOT large GROUP BY source, draw
  UNION ALL SELECT source, -1, 0 FROM wanted
), cuts AS (
  SELECT w.source, CASE WHEN w.want < 0 THEN -1 WHEN w.want >= w.small THEN 1 ELSE (SELECT arg_min(s.draw, (abs(s.upto - w.want), s.draw)) FROM steps s WHERE s.source IS NOT DISTINCT FROM w.source) END AS cut
  FROM wanted w
)
SELECT doc_id, size, source_size, target,
  size * (whole + (fraction > 0 AND CASE WHEN large THEN draw < fraction ELSE draw <= cut END)::BIGINT) AS taken
FROM parts p JOIN cuts c ON p.source IS NOT DISTINCT FROM c.source
"""

_QUALITY = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), f AS (
  SELECT *, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS worded,
    list_transform(range(1, len(w) - 1), lambda i: {'k': w[i] || ' ' || w[i+1] || ' ' || w[i+2], 'i': i}) AS windows,
    list_filter(lines, lambda x:
      (length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) * 2 >= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AND length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) >= 3)
      OR (length(regexp_replace(x, '[^!]+', '', 'g')) * 2 >= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AND length(regexp_replace(x, '[^!]+', '', 'g')) >= 6)
      OR (length(regexp_replace(x, '[^|»•·]+', '', 'g')) >= 3 AND length(regexp_replace(x, '[^|»•·]+', '', 'g')) * 4 >= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))
      OR (regexp_matches(lower(x), '{BOILERPLATE}') AND len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) <= 30)) AS failing
  FROM t
), twice AS (
  SELECT doc_id, list_sort(flatten(list(places))) AS p FROM (
    SELECT doc_id, u.k, list(u.i) AS places FROM (SELECT doc_id, unnest(windows) AS u FROM f) GROUP BY doc_id, u.k HAVING count(*) > 1
  ) GROUP BY doc_id
), r AS (
  SELECT doc_id, len(list_distinct(flatten(list_transform(p, lambda i: [i, i + 1, i + 2]))))::BIGINT AS n FROM twice
), g AS (
  SELECT f.doc_id, n_words, word_chars, n_symbols, (len(worded) - len(list_distinct(worded)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    coalesce(list_sum(list_transform(failing, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))), 0)::BIGINT AS lost_words
  FROM f LEFT JOIN r ON f.doc_id = r.doc_id
), h AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM g)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words, NOT base_failed AND 100 * lost_words <= 30 * n_words AS kept FROM h
"""

_TOPK = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(64 * x::DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, list_inner_product(q.v, r.v)::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20
"""

_SUBSTRINGS = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM s) WHERE n > 1
), word AS (
  SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)
), judged AS (
  SELECT word.doc_id, word.i, word, max(again.i) OVER (PARTITION BY word.doc_id ORDER BY word.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM word LEFT JOIN again ON word.doc_id = again.doc_id AND word.i = again.i
), counted AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM judged GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN counted ON t.doc_id = counted.doc_id
"""


def _codes_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    """Rounds one after the other: distances of all parts to all entries of their position, the first of the least, new means."""
    sql = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), p AS (
  SELECT vec_id, label, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS x FROM v, range({parts}) r(part)
), b0 AS (
  SELECT part, (dense_rank() OVER (ORDER BY vec_id) - 1) AS entry, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries})
)"""
    for n in range(rounds + 1):
        sql += f""", d{n} AS (
  SELECT vec_id, label, p.part, x, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN b{n} b ON p.part = b.part
), a{n} AS (
  SELECT vec_id, label, part, x, entry, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) AS k FROM d{n}) WHERE k = 1
)"""
        if n < rounds:
            sql += f""", m{n} AS (
  SELECT part, entry, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS c FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS i FROM a{n}) GROUP BY part, entry, i
), b{n + 1} AS (
  SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN (SELECT part, entry, list(c ORDER BY i) AS c FROM m{n} GROUP BY part, entry) m ON b.part = m.part AND b.entry = m.entry
)"""
    return sql + f""", coded AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label
), hashed AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, hashed
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the operators that SQL can express over whole tables in reasonable time."""
    return {
        "op1_exact_topk": _TOPK,
        "op4_mixing": _LEVEL,
        "op11_substring_dedup": _SUBSTRINGS,
        "op12_vector_codes": _codes_sql(),
        "op5_quality_rules": _QUALITY.replace("{BOILERPLATE}", quality_rules.BOILERPLATE),
    }
