"""The operators as registered queries over the given tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldnote.llm import ann, lm, mixing, packing, phrases, quality, resampling, secret_scan, simhash, suffix, url_rules, warc, whitening
from fieldnote.session import local_table, scratch_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


def read(spark, sf: str, table: str):
    return spark.read.parquet(f"{sf}/{table}.parquet")


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


@query("op1_url_filters", sql=f"""
WITH r(rhost, rpath, rv) AS (VALUES {_RULE_ROWS}),
u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
    row_number() OVER () AS n
  FROM pages
),
m AS (
  SELECT n, arg_max(rhost || rpath, length(rhost) + length(rpath)) AS rule, arg_max(rv, length(rhost) + length(rpath)) AS rv
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM u LEFT JOIN m USING (n)
""")
def op1_url_filters(spark, sf):
    rules = local_table(spark, URL_RULES, "host string, path string, verdict string")
    return url_rules.filter_urls(read(spark, sf, "pages").select("page_id", "url"), rules).drop("url")


@query("op2_simhash")
def op2_simhash(spark, sf):
    return simhash.near_duplicates(read(spark, sf, "documents"))


@query("op5_mixing")
def op5_mixing(spark, sf):
    return mixing.mixture(read(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op6_packing")
def op6_packing(spark, sf):
    return packing.pack(spark, packing.pieces(read(spark, sf, "documents"), _tokenizer()))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query("op8_quality_rules", sql=f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, row_number() OVER () AS k FROM documents),
x AS (SELECT k, unnest(w[:-3]) AS a, unnest(w[2:-2]) AS b, unnest(w[3:]) AS c, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2),
y AS (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM x),
z AS (SELECT k, count(DISTINCT j) AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM y WHERE n > 1) GROUP BY k),
l AS (
  SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY k
),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals
  FROM d LEFT JOIN z USING (k) LEFT JOIN l USING (k)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines
    OR 100 * n_capitals > 50 * word_chars OR word_chars > 20 * n_words) AS kept
FROM m
""")
def op8_quality_rules(spark, sf):
    docs = quality.ledger(read(spark, sf, "documents").select("doc_id", "text"))
    m = F.col("ledger.measures")
    failures = F.col("ledger.failures")
    return docs.select(
        "doc_id",
        *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        (~quality.passes(failures, 1)).alias("base_failed"),
        quality.passes(failures, 2).alias("kept"),
    )


@query("op10_secret_scans")
def op10_secret_scans(spark, sf):
    return secret_scan.scan_secrets(read(spark, sf, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"
    )


@query("op3_substring_dedup", sql=f"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, text) AS k, {_WORDS} AS w FROM documents),
x AS (SELECT k, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
y AS (
  SELECT k, i, string_agg(w, ' ') OVER f AS s, count(*) OVER f AS n FROM x
  WINDOW f AS (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
),
z AS (SELECT k, i, row_number() OVER (PARTITION BY s ORDER BY k, i) AS r FROM y WHERE n = 20),
g AS (SELECT DISTINCT k, unnest(range(i, i + 20)) AS i FROM z WHERE r > 1),
s AS (
  SELECT x.k, count(g.k) AS n_removed, string_agg(w, ' ' ORDER BY x.i) FILTER (WHERE g.k IS NULL) AS kept
  FROM x LEFT JOIN g ON x.k = g.k AND x.i = g.i GROUP BY x.k
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (k)
""")
def op3_substring_dedup(spark, sf):
    return phrases.dedup(read(spark, sf, "documents"))


@query("op9_lm_scoring")
def op9_lm_scoring(spark, sf):
    return lm.score(read(spark, sf, "documents"))


@query("op7_nearest_neighbours")
def op7_nearest_neighbours(spark, sf):
    return ann.search(read(spark, sf, "embeddings")).select("query_id", "rank", "vec_id", "score")


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark, sf):
    return suffix.dedup(read(spark, sf, "documents"))


@query("op11_warc", sql="""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, row_number() OVER () AS k FROM pages),
q AS (
  SELECT page_id, h, row_number() OVER w AS r, first_value(page_id) OVER w AS top
  FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id DESC NULLS LAST, k)
)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN r > 1 AND strlen(h) >= 1000 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN r > 1 AND strlen(h) >= 1000 THEN top END AS refers_to
FROM q
""")
def op11_warc(spark, sf):
    path = scratch_path(spark, "archives")
    warc.write(read(spark, sf, "pages"), path)
    found = warc.resolved(warc.captures(warc.read(spark, path)))
    return found.select(
        F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"), F.col("referred").cast("long").alias("refers_to"),
    )


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark, sf):
    found = whitening.whiten(read(spark, sf, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


@query("op13_importance_resampling")
def op13_importance_resampling(spark, sf):
    found = resampling.scored(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
