"""One thin query per operator, over whole tables, with the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import ball_tree, html_text, line_dedup, lm_score, merkle, mixing, packing, quality, secrets, simhash, substring_dedup, token_counts, token_links
from fathomline.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, max_repeat=2.0).select("doc_id", "source", F.col("epoch").cast("long").alias("epoch"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def listed(*kinds: str) -> Column:
        return F.concat_ws(",", F.transform(of(*kinds), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(*secrets.BASE_KINDS), 256).alias("base_sha256"), listed(*secrets.KINDS).alias("spans"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.verdicts(quality.stored_ledger(table(spark, sf_dir, "documents")))
    base = F.col("fail_bits").bitwiseAND(F.lit(quality.POLICIES["base"])) != 0
    return book.select("doc_id", *quality.MEASURES[:5], base.alias("base_failed"), "kept", "fail_bits")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.edit_likeness(table(spark, sf_dir, "documents"))
    return found.withColumn("edited", F.sha2("edited", 256)).withColumnRenamed("edited", "edited_sha256")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents"), least_chars=40, least_docs=5)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_links.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, vocabulary("piece_bpe_32k.model"))


def op13_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, salt="3:")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_lm_score, op3_mix_sources, op4_secret_scan, op5_html_text, op6_simhash, op7_packing, op8_quality_rules, op9_token_counts, op10_merkle,
              op11_line_dedup, op12_token_links, op13_ball_tree)
}



def _rounds_sql(rounds: int) -> str:
    """One table of vectors by nearest centroid and one of moved centroids a round."""
    far = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - m.x[i]) * (v.x[i] - m.x[i])))"
    out = []
    for i in range(rounds + 1):
        out.append(f"a{i} AS MATERIALIZED (SELECT r, any_value(x) AS x, min({{'d': d, 'c': c}}) AS n FROM (SELECT v.r, v.x, m.c, {far} AS d FROM v CROSS JOIN c{i} m) GROUP BY r)")
        if i < rounds:
            moved = "list_transform(range(1, 65), lambda i: CAST(floor(list_sum(list_transform(l, lambda y: y[i]))::DOUBLE / len(l)) AS BIGINT))"
            out.append(f"c{i + 1} AS MATERIALIZED (SELECT m.c, CASE WHEN g.l IS NULL THEN m.x ELSE {moved} END AS x FROM c{i} m LEFT JOIN (SELECT n.c AS c, list(x) AS l FROM a{i} GROUP BY 1) g ON g.c = m.c)")
    return ",\n".join(out)


ORACLES = {
    "op11_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.holder AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
""",
    "op13_ball_tree": f"""
WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS e FROM embeddings WHERE len(embedding) = 64),
v AS MATERIALIZED (SELECT vec_id, r, list_transform(e, lambda y: CAST(floor(1024 * y) AS BIGINT)) AS x FROM r WHERE len(list_filter(e, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), x) - 1 AS c, x FROM v ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), x LIMIT 8),
{_rounds_sql(10)}
SELECT v.vec_id, CAST(n.c AS INTEGER) AS cluster, CAST(n.d AS BIGINT) AS distance, CAST(sum(n.d) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(n.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.x, ',')) AS centroid_sha256
FROM a10 JOIN v ON v.r = a10.r JOIN c10 m ON m.c = n.c
""",
    "op10_merkle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
x AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nx FROM d),
e AS (SELECT *, left(t, CAST(n - n // 2 AS BIGINT)) || left(nx, CAST(n // 2 AS BIGINT)) AS ed FROM x),
f AS (SELECT doc_id, v, s FROM (SELECT doc_id, unnest(['t', 'e', 'n']) AS v, unnest([t, ed, nx]) AS txt FROM e),
  LATERAL (SELECT list_transform(string_split(txt, chr(10) || chr(10)), lambda sec: array_to_string(list_transform(string_split(sec, chr(10)),
    lambda par: array_to_string(list_transform(string_split(par, '. '), lambda q: left(md5(q), 12)), '.')), ',')) AS s)),
g AS (SELECT doc_id, v, md5(array_to_string(list_transform(s, lambda sec: md5(array_to_string(list_transform(string_split(sec, ','),
    lambda par: md5(par)), '.'))), '.')) || '/' || array_to_string(s, ';') AS fp, list_distinct(string_split(replace(replace(array_to_string(s, ';'), ';', '.'), ',', '.'), '.')) AS lv FROM f),
h AS (SELECT e.doc_id, CAST(n AS BIGINT) AS n_chars, sha256(ed) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint,
    CASE WHEN a.fp = b.fp THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a.lv, b.lv)) / (len(a.lv) + len(b.lv)) END AS near_edited,
    CASE WHEN a.fp = c.fp THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a.lv, c.lv)) / (len(a.lv) + len(c.lv)) END AS near_next
  FROM e JOIN g a ON a.doc_id = e.doc_id AND a.v = 't' JOIN g b ON b.doc_id = e.doc_id AND b.v = 'e' JOIN g c ON c.doc_id = e.doc_id AND c.v = 'n')
SELECT * FROM h
""",
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 48, 1))) AS i, w FROM d),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS x FROM g),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS least FROM h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM f WHERE least < doc_id),
k AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(gone, j)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
""",
    "op8_quality_rules": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 3, 1))) AS i, w FROM d),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i+4], ' ')) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM h WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
         len(l) AS n_lines, len(list_filter(w, lambda x: suffix(x, '!!'))) AS n_shouts
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id),
b AS (
  SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)
    + (CASE WHEN 2 * n_shouts > n_words THEN 64 ELSE 0 END) AS BIGINT) AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits % 4 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
""",
}
