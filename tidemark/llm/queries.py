"""The operators as queries over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, ctph, decontam, disclosure, hardneg, langid, licenses, linededup, mixing, runindex, simhash, warcaudit, wavelet
from tidemark.llm.common import table

MIX_SEED = 42
MIX_PERCENT = 70
MIX_EPOCHS = 2


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_run_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.digest(runindex.without_long_matches(spark, table(spark, sf_dir, "documents")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    net = langid.fit(docs.where("NOT held_out"))
    return langid.predict(docs.select("doc_id", "text", "held_out"), net).select("doc_id", "held_out", "lang_pred", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = linededup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL3 = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i, list_aggregate(ls[i:i+2], 'string_agg', chr(10)) AS t
      FROM (SELECT doc_id, ls, unnest(range(1, greatest(len(ls) - 1, 1))) AS i FROM l)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS n FROM w),
g AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1),
d AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
k AS (SELECT l.doc_id, len(ls) AS n, coalesce(len(gone), 0) AS c, text, gone,
             list_filter(list_transform(range(1, len(ls) + 1), lambda x: CASE WHEN list_contains(gone, x) THEN NULL ELSE ls[x] END), lambda y: y IS NOT NULL) AS kept
      FROM l LEFT JOIN d USING (doc_id))
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(c AS BIGINT) AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN text ELSE coalesce(list_aggregate(kept, 'string_agg', chr(10)), '') END) AS kept_sha256
FROM k
"""


def replica(records: DataFrame) -> DataFrame:
    """A damaged copy, derived from the records alone: by the hash of a URL about one record in 64 has a byte
    replaced, one is lost and one turns up at a new position."""
    spot = F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 2)
    changed = F.when(spot.between("00", "03"), F.overlay("record", F.lit("#").cast("binary"), F.lit(9))).otherwise(F.col("record"))
    moved = F.when(spot.between("08", "0b"), -1 - F.col("position")).otherwise(F.col("position"))
    return records.where(~spot.between("04", "07")).withColumns({"record": changed, "position": moved})


def op4_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    records = pages.select(F.col("page_id").alias("position"), "url", warcaudit.warc_record(F.col("url"), F.col("html")).alias("record"))
    return warcaudit.audit(spark, records, replica(records))


SQL4 = """
WITH a AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, substr(md5(coalesce(url, '')), 1, 2) AS spot FROM pages),
b AS (SELECT page_id, spot, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
      || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html
      || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM a),
l AS (SELECT page_id AS position, sha256(record) AS l FROM b),
r AS (SELECT CASE WHEN spot BETWEEN '08' AND '0b' THEN -1 - page_id ELSE page_id END AS position,
             sha256(CASE WHEN spot BETWEEN '00' AND '03' THEN substr(record, 1, 8) || '#' || substr(record, 10) ELSE record END) AS r
      FROM b WHERE spot NOT BETWEEN '04' AND '07')
SELECT position, CASE WHEN r IS NULL THEN 'missing' WHEN l IS NULL THEN 'extra' ELSE 'changed' END AS status,
       l AS left_sha256, r AS right_sha256
FROM l FULL OUTER JOIN r USING (position) WHERE l IS DISTINCT FROM r
"""


def op5_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ctph.fingerprints(table(spark, sf_dir, "documents"), parts)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_spans(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.digest(decontam.scan_documents(spark, docs, table(spark, sf_dir, "benchmark")))


SQL8 = r"""
WITH norm AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bench AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS size, list_aggregate(ws[i:i+9], 'string_agg', ' ') AS t
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM bench WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
dw AS (
  SELECT doc_id, i, size, list_aggregate(ws[i:i+size-1], 'string_agg', ' ') AS t
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM norm, sizes)),
hit AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN win ON dw.t = win.t AND dw.size = win.size),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(ws), 0) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(ids.n, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM norm LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


def op9_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.encode_documents(spark, table(spark, sf_dir, "documents"), tokenizer_path())


def mix_domain() -> Column:
    """The table has no domain column; a source's hash puts it into one of two domains."""
    first = F.substring(F.md5(F.coalesce("source", F.lit(""))), 1, 1)
    return F.when(first < "6", "reference").otherwise("web")


def mix_weights() -> dict[str, Column]:
    return {
        "domain": F.when(F.col("domain") == "reference", 2).otherwise(3),
        "lang": F.when(F.col("lang") == "en", 4).when(F.col("lang") == "de", 2).otherwise(1),
        "source": F.lit(1),
    }


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mixed(docs, mix_domain(), mix_weights(), MIX_SEED, MIX_PERCENT, MIX_EPOCHS)


def _share_sql(name: str, nodes: str, parent: str, level: str, weight: str, keep: str) -> str:
    over = f"PARTITION BY {parent} ORDER BY cap / w, {level}" if parent else f"ORDER BY cap / w, {level}"
    whole = f"PARTITION BY {parent}" if parent else ""
    return f"""
{name}_w AS (SELECT *, {weight} AS w FROM ({nodes})),
{name}_r AS (SELECT *, budget - sum(cap) OVER ({over} ROWS UNBOUNDED PRECEDING) + cap AS rest,
                    sum(w) OVER ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM {name}_w),
{name}_f AS (SELECT *, CAST(cap AS HUGEINT) * open <= CAST(rest AS HUGEINT) * w AS full_ FROM {name}_r),
{name} AS (SELECT {keep}, CAST(CASE WHEN full_ THEN cap ELSE greatest(w * max(rest) FILTER (NOT full_) OVER ({whole})
                    // max(open) FILTER (NOT full_) OVER ({whole}), 0) END AS BIGINT) AS given FROM {name}_f)"""


SQL10 = f"""
WITH t AS (SELECT doc_id, CASE WHEN substr(md5(coalesce(source, '')), 1, 1) < '6' THEN 'reference' ELSE 'web' END AS domain,
                  coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
                  CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\t\\n\\x0B\\f\\r ]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS avail, CAST(sum(n_tokens) * {MIX_EPOCHS} AS BIGINT) AS cap FROM t GROUP BY ALL),
{_share_sql("b1", f"SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, (SELECT CAST(sum(avail) * {MIX_PERCENT} // 100 AS BIGINT) FROM leaf) AS budget FROM leaf GROUP BY domain", "", "domain", "CASE domain WHEN 'reference' THEN 2 ELSE 3 END", "domain")},
{_share_sql("b2", "SELECT domain, lang, CAST(sum(cap) AS BIGINT) AS cap, any_value(given) AS budget FROM leaf JOIN b1 USING (domain) GROUP BY domain, lang", "domain", "lang", "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 ELSE 1 END", "domain, lang")},
{_share_sql("b3", "SELECT domain, lang, source, avail, cap, given AS budget FROM leaf JOIN b2 USING (domain, lang)", "domain, lang", "source", "1", "domain, lang, source, avail")},
e AS (SELECT *, least(greatest(given - epoch * avail, 0), avail) AS part FROM b3, (SELECT CAST(unnest(range({MIX_EPOCHS})) AS INTEGER) AS epoch)),
o AS (SELECT t.*, epoch, part, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch
             ORDER BY md5('{MIX_SEED}:' || epoch || ':' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM t JOIN e USING (domain, lang, source) WHERE part > 0)
SELECT doc_id, domain, lang, source, epoch, n_tokens, CAST(least(n_tokens, part - before) AS BIGINT) AS n_taken
FROM o WHERE before < part OR part = (SELECT a.avail FROM b3 a WHERE (a.domain, a.lang, a.source) = (o.domain, o.lang, o.source))
"""



def op11_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.digest(disclosure.sanitizing_spans(spark, table(spark, sf_dir, "documents")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.alignment(spark, docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")).drop("groups")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.hard_negatives(spark, table(spark, sf_dir, "embeddings"))


SQL13 = """
WITH r AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

QUERIES = {
    "op1_run_index_dedup": op1_run_index_dedup,
    "op2_language_id": op2_language_id,
    "op3_line_dedup": op3_line_dedup,
    "op4_warc_audit": op4_warc_audit,
    "op5_piecewise_hash": op5_piecewise_hash,
    "op6_license_scan": op6_license_scan,
    "op7_simhash": op7_simhash,
    "op8_decontamination": op8_decontamination,
    "op9_wavelet_tokens": op9_wavelet_tokens,
    "op10_mixture": op10_mixture,
    "op11_disclosure": op11_disclosure,
    "op12_alignment": op12_alignment,
    "op13_hard_negatives": op13_hard_negatives,
}
SQL = {"op3_line_dedup": SQL3, "op4_warc_audit": SQL4, "op8_decontamination": SQL8, "op10_mixture": SQL10, "op13_hard_negatives": SQL13}
