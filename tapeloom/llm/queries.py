"""Queries op1 to op13: each applies its operator to its whole table and derives the columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, clusters, decontaminate, divergence, html, language, licences, packing, repeats, simhash, urls, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(_table(spark, sf_dir, "documents")).drop("matches")


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = urls.table(spark, urls.RULES, ("host", "path", "verdict"))
    return urls.filtered(_table(spark, sf_dir, "pages"), rules, urls.table(spark, urls.BLOCKED, ("host", "path")))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(_table(spark, sf_dir, "documents"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = urls.table(spark, (("0", "user", said), ("1", "assistant", said)), ("turn", "role", "text"))
    own = own.select(F.lit(-1).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.formatted(rows))


def without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repeats.removed(_table(spark, sf_dir, "documents"), passage=51)
    size = lambda runs: F.aggregate(runs, F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    many = lambda runs: F.size(runs).cast("long")
    got = got.select("doc_id", "n_bytes", size("spans").alias("n_removed"), many("spans").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), many("passages").alias("n_passages"), size("passages").alias("n_passage_words"), "kept")
    return got.withColumn("removed_share", F.coalesce(F.try_divide(F.col("n_removed").cast("double"), F.col("n_bytes")), F.lit(0.0))).withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans", "items")


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(_table(spark, sf_dir, "pages"))


def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe.decoded(bpe.encoded(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids"))
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def vector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(_table(spark, sf_dir, "embeddings"))


def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_license_scan": licence_scan,
    "op2_best_fit_packing": packed,
    "op3_url_filter": url_verdicts,
    "op4_language_id": languages,
    "op5_chat_formatting": chats,
    "op6_suffix_array_dedup": without_repeats,
    "op7_benchmark_decontamination": contamination,
    "op8_html_extraction": page_texts,
    "op9_simhash_near_dedup": near_copies,
    "op10_embedding_near_dedup": near_vectors,
    "op11_bpe_round_trip": bpe_round_trip,
    "op12_centroid_clustering": vector_clusters,
    "op13_source_divergence": source_divergence,
}

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)
_BLOCKED = ", ".join(f"('{h}', '{p}')" for h, p in urls.BLOCKED)
_URLS = f"""
WITH rules(rh, rp, rv) AS (VALUES {_RULES}),
blocked(bh, bp) AS (VALUES {_BLOCKED}),
parts AS (
  SELECT page_id, coalesce(url, '') AS u,
    translate(regexp_extract(coalesce(url, ''), '^((?s:.*?))://([^/?#]*)([^?#]*)', 2), '{urls.UPPER}', '{urls.LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '^((?s:.*?))://([^/?#]*)([^?#]*)', 3) AS path
  FROM pages),
best AS (
  SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY host, path),
also AS (
  SELECT DISTINCT host, path FROM (SELECT DISTINCT host, path FROM parts) p
  JOIN blocked ON (host = bh OR ends_with(host, '.' || bh)) AND starts_with(path, bp))
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, CASE WHEN a.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path LEFT JOIN also a ON p.host = a.host AND p.path = a.path
"""

_MARKS = "|".join(m.replace("[", r"\[").replace("]", r"\]") for m in chat.LLAMA.marks)
_OWN = " ".join(f"WHEN role = '{n}' THEN {len(r.open + r.close)}" for n, r in chat.LLAMA.roles.items())
_NAMED = len(chat.LLAMA.name_open + chat.LLAMA.name_close + chat.LLAMA.other.open + chat.LLAMA.other.close)


def _grown(x: str) -> str:
    return f"length({x}) + length({x}) - length(replace({x}, '\\', '')) + 2 * len(regexp_extract_all({x}, '{_MARKS}'))"


_CHATS = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, CASE {_OWN} ELSE {_NAMED} + {_grown("role")} END + {_grown("text")} AS chars FROM rows_),
talks AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS lost,
    string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE '?' END, '' ORDER BY turn NULLS FIRST, role, text) AS roles,
    sum(chars)::BIGINT AS formatted_chars
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(lost) AS loss_chars, sha256(lost) AS loss_sha256, formatted_chars,
  regexp_full_match(roles, 's?(ua)+') AS valid
FROM talks
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')" % (urls.UPPER, urls.LOWER)
_CONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, w FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
spots AS (
  SELECT item, least(13, len(w)) AS n, array_to_string(list_slice(w, k, k + least(13, len(w)) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i)),
sizes AS (SELECT DISTINCT n FROM spots),
hits AS (
  SELECT DISTINCT rid, k, n, item FROM (
    SELECT rid, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS win
    FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)) JOIN spots USING (n, win)),
hit AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(k, k + n)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""

_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(low.b, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(low.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN low ON low.a = e.vec_id
"""



def _rounds(k: int = 8, rounds: int = 10) -> str:
    """Every round as two tables: the vectors' clusters, and the centroids that follow from them."""
    near = (
        "SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.rid, m.c, sum((v.x - m.x) * (v.x - m.x)) AS d "
        "FROM v JOIN {m} m ON v.i = m.i GROUP BY v.rid, m.c) GROUP BY rid"
    )
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(m=f'm{r}')})")
        mean = f"SELECT c, i, (s - ((s % n) + n) % n) // n AS x FROM (SELECT a.c, v.i, sum(v.x)::HUGEINT AS s, count(*) AS n FROM a{r} a JOIN v USING (rid) GROUP BY a.c, v.i)"
        steps.append(f"m{r + 1} AS MATERIALIZED (SELECT m.c, m.i, coalesce(n.x, m.x) AS x FROM m{r} m LEFT JOIN ({mean}) n USING (c, i))")
    steps.append(f"last AS MATERIALIZED ({near.format(m=f'm{rounds}')})")
    return ", ".join(steps)


_CLUSTERS = f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT rid, unnest(range(64)) AS i, unnest(e) AS x FROM e),
begin_ AS (SELECT rid, row_number() OVER (ORDER BY sha256('3:' || vec_id), e) - 1 AS c FROM e QUALIFY c < 8),
m0 AS MATERIALIZED (SELECT c, i, x::HUGEINT AS x FROM begin_ JOIN v USING (rid)),
{_rounds()},
sha AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS sha FROM m10 GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha AS centroid_sha256
FROM last JOIN e USING (rid) JOIN sha USING (c)
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')" % (urls.UPPER, urls.LOWER)
_APART = "((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)"
_DIVERGENCE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS w FROM documents),
occurs AS MATERIALIZED (SELECT rid, lang, source, term, count(*) AS n FROM (SELECT rid, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term FROM occurs GROUP BY ALL HAVING count(*) >= 10),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
counts AS MATERIALIZED (
  SELECT lang, source, term, coalesce(n, 0) AS n FROM groups JOIN kept USING (lang)
  LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM occurs GROUP BY ALL) USING (lang, source, term)),
p AS MATERIALIZED (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // ((sum(n) OVER (PARTITION BY lang, source)) + 2 * v) AS p
  FROM counts JOIN sizes USING (lang)),
q AS MATERIALIZED (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // ((sum(n) OVER (PARTITION BY lang)) + 2 * v) AS p
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL) JOIN sizes USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum({_APART}) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT a.lang, a.source, 'term', a.term, {_APART} FROM p a JOIN q b USING (lang, term) WHERE a.n > 0 AND a.p > b.p)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 10
"""

ORACLE_SQL = {
    "op3_url_filter": _URLS,
    "op5_chat_formatting": _CHATS,
    "op7_benchmark_decontamination": _CONTAMINATION,
    "op10_embedding_near_dedup": _VECTORS,
    "op12_centroid_clustering": _CLUSTERS,
    "op13_source_divergence": _DIVERGENCE,
}
