"""The queries of the llm operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import ann, bytepair, langid, licences, linedup, packing, polyhash, prefixcount, simhash, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytepair.bpe_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polyhash.edit_fingerprints(_table(spark, sf_dir, "documents"))


def captures(pages: DataFrame) -> DataFrame:
    """Capture records of the pages: each a full response, every second one also a revisit later on."""
    page, html = F.col("page_id"), F.col("html")
    tag = F.concat(F.lit('"'), F.substring(F.md5(html), 1, 16), F.lit('"'))
    date = F.concat(F.lit("lm-"), page.cast("string"))
    later = page * 10 + 5 + (page % 7) * 1000
    text = lambda x: x.cast("string")
    none = F.lit(None).cast("string")
    response = F.struct(
        (page * 2).alias("record_id"),
        F.lit("response").alias("warc_type"),
        (page * 10).alias("ts"),
        F.col("tag").alias("etag"),
        F.when(page % 3 != 0, date).alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), text(F.length(html)), F.lit("ETag"), F.col("tag"), F.lit("Date"), text(page * 10)).alias("headers"),
    )
    etag = F.when(page % 5 == 0, F.lit('"gone"')).when(page % 11 != 0, F.concat(F.lit("W/"), F.col("tag")))
    revisit = F.struct(
        (page * 2 + 1).alias("record_id"),
        F.lit("revisit").alias("warc_type"),
        later.alias("ts"),
        etag.alias("etag"),
        F.when(etag.isNull() & (page % 3 == 1), date).otherwise(none).alias("last_modified"),
        F.create_map(F.lit("etag"), etag, F.lit("date"), text(later), F.lit("cache-control"), F.concat(F.lit("max-age="), text(page % 100)), F.lit("content-length"), F.lit("0")).alias("headers"),
    )
    return pages.withColumn("tag", tag).select("url", F.explode(F.when(page % 2 == 0, F.array(response, revisit)).otherwise(F.array(response))).alias("r")).select("url", "r.*")


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(captures(_table(spark, sf_dir, "pages")))
    return out.select("record_id", "canonical_url", "refers_to", "status", warc.header_text(F.col("headers")).alias("headers"))


OP3_SQL = r"""
WITH base AS (
  SELECT page_id AS p, url, '"' || substr(md5(html), 1, 16) || '"' AS tag, length(html) AS n FROM pages
), canon AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM base
), urls AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www[.]', '') AS host,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(bare, '^[^/?]*(.*)$', 1),
      '([?&])(utm_[a-z]+|ref|gclid|fbclid)=[^&]*', '\1', 'g'), '[?]&+', '?', 'g'), '&+', '&', 'g'), '[?&]$', '') AS rest
  FROM canon
), keyed AS (
  SELECT p, tag, n, host || regexp_replace(rest, '/$', '') AS canonical_url FROM urls
), responses AS (
  SELECT p * 2 AS record_id, canonical_url, p * 10 AS ts, tag AS etag, CASE WHEN p % 3 <> 0 THEN 'lm-' || p END AS lm, n FROM keyed
), revisits AS (
  SELECT p, p * 2 + 1 AS record_id, canonical_url, p * 10 + 5 + (p % 7) * 1000 AS ts,
    CASE WHEN p % 5 = 0 THEN '"gone"' WHEN p % 11 <> 0 THEN 'W/' || tag END AS etag FROM keyed WHERE p % 2 = 0
), dated AS (
  SELECT *, CASE WHEN etag IS NULL AND p % 3 = 1 THEN 'lm-' || p END AS lm FROM revisits
), met AS (
  SELECT v.*, r.record_id AS refers_to, r.ts AS r_ts, r.etag AS r_etag, r.lm AS r_lm, r.n AS r_n
  FROM dated v ASOF LEFT JOIN responses r ON v.canonical_url = r.canonical_url AND v.ts > r.ts
), judged AS (
  SELECT *, CASE WHEN refers_to IS NULL THEN 'no_original'
    WHEN etag IS NOT NULL AND r_etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = r_etag THEN 'resolved' ELSE 'validator_mismatch' END
    WHEN lm IS NOT NULL AND r_lm IS NOT NULL THEN CASE WHEN lm = r_lm THEN 'resolved' ELSE 'validator_mismatch' END
    ELSE 'no_validator' END AS status FROM met
)
SELECT record_id, canonical_url, refers_to, status,
  CASE WHEN status = 'resolved' THEN 'cache-control: max-age=' || (p % 100) || '|content-length: ' || r_n || '|content-type: text/html|date: ' || ts
    || '|etag: ' || coalesce(etag, r_etag) END AS headers
FROM judged
"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixcount.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 512)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    model = langid.train(documents.filter(~out))
    return langid.identify(documents.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linedup.drop_boilerplate(_table(spark, sf_dir, "documents"), counters=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


OP8_SQL = """
WITH lines AS (
  SELECT doc_id, source, md5(text) AS page, text, i, l, trim(translate(l, chr(9) || chr(13) || chr(11) || chr(12), '    ')) AS k
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)
), totals AS (
  SELECT source, count(DISTINCT md5(text)) AS pages FROM documents WHERE text IS NOT NULL GROUP BY source
), known AS (
  SELECT l.source, l.k FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
  WHERE l.k <> ''
  GROUP BY l.source, l.k, t.pages HAVING count(DISTINCT l.page) > 0.1 * t.pages AND count(DISTINCT l.page) >= 3
), marked AS (
  SELECT l.*, (SELECT count(*) FROM known b WHERE b.source IS NOT DISTINCT FROM l.source AND b.k = l.k) AS gone FROM lines l
)
SELECT doc_id, count(*) AS n_lines, sum(gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN gone = 0 THEN l END, chr(10) ORDER BY i), '')) AS text_sha256
FROM marked GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.recognise(_table(spark, sf_dir, "documents"))


def _op9_sql() -> str:
    """Word by word: a sentence's words side by side, a mark before the first and after the last, no paragraph's end between.

    Of sentences from one word the longest counts, and none that starts inside one that starts before.
    """
    known = ", ".join(f"(string_split('{s}', ' '), '{i}')" for i, s in licences.SENTENCES.items())
    rules = ", ".join(f"({n + 1}, '{name}', ',{','.join(ids)},')" for n, (name, ids) in enumerate(licences.RULES))
    return f"""
WITH known(a, id) AS (VALUES {known}), rules(rule, licence, ids) AS (VALUES {rules}),
marked AS (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '\\n[^a-z0-9\\n]*\\n[^a-z0-9]*', 'P', 'g'),
    '[.!?;:]+[ \\t\\r\\n\\f]+|\\n+', 'S', 'g'), '[^a-z0-9PS]+', ' ', 'g') AS t FROM documents
), tokens AS (
  SELECT doc_id, string_split(replace(replace('P' || t || 'P', 'P', ' P '), 'S', ' S '), ' ') AS ts FROM marked
), each AS (
  SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS p FROM tokens
), told AS (
  SELECT *, lag(t) OVER w IN ('P', 'S') AS opens, lead(t) OVER w IN ('P', 'S') AS closes, sum((t = 'P')::INT) OVER w AS paragraph
  FROM each WHERE t <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY p)
), words AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM told WHERE t NOT IN ('P', 'S')
), texts AS (
  SELECT doc_id, list(t ORDER BY p) AS ws, list(closes ORDER BY p) AS ends, list(paragraph ORDER BY p) AS ps FROM words GROUP BY doc_id
), met AS (
  SELECT w.doc_id, w.i, k.id, len(k.a) AS m FROM words w JOIN known k ON w.opens AND w.t = k.a[1] JOIN texts x ON x.doc_id = w.doc_id
  WHERE x.ws[w.i : w.i + len(k.a) - 1] = k.a AND x.ends[w.i + len(k.a) - 1] AND x.ps[w.i + len(k.a) - 1] = w.paragraph
), longest AS (
  SELECT doc_id, i, arg_max(id, m) AS id, max(m) AS m FROM met GROUP BY doc_id, i
), found AS (
  SELECT doc_id, string_agg(id, ',' ORDER BY i) AS ids, count(*) AS n FROM longest b
  WHERE NOT EXISTS (SELECT 1 FROM longest e WHERE e.doc_id = b.doc_id AND e.i < b.i AND b.i < e.i + e.m) GROUP BY doc_id
), ruled AS (
  SELECT f.doc_id, min(r.rule) AS rule, min_by(r.licence, r.rule) AS licence
  FROM found f JOIN rules r ON contains(',' || f.ids || ',', r.ids) GROUP BY f.doc_id
)
SELECT d.doc_id, coalesce(f.ids, '') AS sentence_ids, coalesce(f.n, 0) AS n_known, r.rule::BIGINT AS rule, r.licence
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id LEFT JOIN ruled r ON d.doc_id = r.doc_id
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_fingerprints": op2_fingerprints,
    "op3_revisits": op3_revisits,
    "op4_token_counts": op4_token_counts,
    "op5_language": op5_language,
    "op6_neighbours": op6_neighbours,
    "op7_simhash": op7_simhash,
    "op8_lines": op8_lines,
    "op9_licences": op9_licences,
    "op10_packing": op10_packing,
}

ORACLES: dict[str, str] = {"op3_revisits": OP3_SQL, "op8_lines": OP8_SQL, "op9_licences": _op9_sql()}
