"""The queries op1 to op13 over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.llm import bpe, decontaminate, embeddings, infill, langid, pii, simhash, substrings, suffixtree, tokenfile, toxicity, urlfilter, whiten
from veriframe.llm.common import table

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score(table(spark, sf_dir, "documents"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.report(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_pii, op3_token_files, op4_language, op5_simhash, op6_decontamination, op7_substrings, op8_lm_score, op9_embeddings, op10_bpe, op11_fill_in_middle, op12_whitening, op13_toxicity)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SQL = {
    "op1_url_filter": r"""
WITH rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, (SELECT rh || rp FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC LIMIT 1) AS rule,
  coalesce((SELECT v FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC LIMIT 1), 'allow') AS verdict FROM u""",
    "op6_decontamination": rf"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark), il AS (SELECT item_id, w, least(5, len(w)) AS l FROM i WHERE len(w) > 0),
s AS (SELECT DISTINCT item_id, l, array_to_string(w[k:k + l - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS k FROM il)),
n AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY item_id),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents), sizes AS (SELECT DISTINCT l FROM s),
g AS (SELECT DISTINCT doc_id, l, array_to_string(w[k:k + l - 1], ' ') AS g FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM d, sizes WHERE len(w) >= l))
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment FROM g JOIN s USING (l, g) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= ceil(0.8 * n_item - 1e-9)""",
    "op9_embeddings": """
WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
r(a, c) AS (SELECT vec_id, vec_id FROM e UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, m.c AS component_id, vec_id = m.c AS kept FROM e JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) AS m ON m.a = vec_id""",
    "op11_fill_in_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
  CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS lo, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS hi FROM u),
c AS (SELECT doc_id, len(u) AS n, form, t, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c""",
}
