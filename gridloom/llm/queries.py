"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, centroids, chat, decontam, html_extract, langid, media, quality, sharding, simhash, toxicity, url_filter
from .common import checkpoint, crc_mod, labelled_texts, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(mod: int, rest: int):
    """Null ids are neither trained on nor held out."""
    return F.coalesce(crc_mod("doc_id", mod) == rest, F.lit(False)).alias("held_out")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "pattern_rule")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def toxicity_grammar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Grammar:
    return toxicity.learn(labelled_texts(docs, table(spark, sf_dir, "labels"), "toxic", 5, 0, toxicity.MAX_ROWS, toxicity.MAX_CHARS))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity_grammar(spark, docs, sf_dir)).select("doc_id", held_out(5, 0), "score", "predicted")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 16)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, lanes=1, distance=3)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of all texts are found once; the ranking is fitted to those of all labelled rows, and scores them all."""
    marks = (F.xxhash64(F.lit(k), F.coalesce("text", F.lit(""))).alias(name) for k, name in ((1, "one"), (2, "two")))
    rows = checkpoint(quality.described(table(spark, sf_dir, "documents").select("doc_id", "text", *marks), keep=("doc_id", "one", "two")))
    ranking = quality.fit(checkpoint(quality.labelled(rows, table(spark, sf_dir, "labels"), "quality", 3, 1)))
    return quality.scored(rows, ranking).select("doc_id", held_out(3, 1), "score", "predicted")


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.sample_texts(docs)).select("doc_id", held_out(5, 0), "lang_pred", "score")


#: A fixed value of the contract: a conversation whose texts look like control strings.
ODD_CONVERSATION = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame(ODD_CONVERSATION, "conv_id bigint, turn bigint, role string, text string")
    made = chat.format_conversations(chat.log_of(given.unionByName(odd)), sequence=("turn", "step"))
    return chat.digest(made).withColumnRenamed("conv", "conv_id")


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, components=64, scale=64, seed="1")


QUERIES = {f.__name__: f for f in (op1_bpe, op2_url_filter, op3_html_extract, op4_media, op5_toxicity, op6_sharding, op7_simhash, op8_quality, op9_decontam, op10_langid, op11_chat, op12_align, op13_centroids)}

_WORDS = ", ".join(f"'{w}'" for w in url_filter.HOST_WORDS)

_DISTANCE = "list_sum(list_transform(range(1, 65), lambda i: (a.x[i] - c.x[i]) * (a.x[i] - c.x[i])))"


def _centroid_rounds(rounds: int) -> str:
    """CTEs n1, c1, n2, c2, ...: nearest centroids of each round and the centroids after it."""
    nearest = lambda r: f"n{r + 1} AS (SELECT k, first(j ORDER BY d, j) AS j, min(d) AS d FROM (SELECT k, j, {_DISTANCE} AS d FROM a, c{r} AS c) GROUP BY k)"
    parts = []
    for r in range(rounds):
        parts += [
            nearest(r),
            f"""m{r + 1} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x
               FROM (SELECT j, i, sum(v) AS s, count(*) AS n FROM (SELECT j, unnest(range(1, 65)) AS i, unnest(x) AS v FROM n{r + 1} JOIN a USING (k)) GROUP BY j, i) GROUP BY j)""",
            f"c{r + 1} AS (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{r} AS c LEFT JOIN m{r + 1} AS m USING (j))",
        ]
    return ",\n".join([*parts, nearest(rounds)])


ORACLE_SQL = {
    "op2_url_filter": rf"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{url_filter.UPPER}', '{url_filter.LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r AS (
  SELECT *, '.' || host AS d,
         list_min(list_filter([{_WORDS}], lambda w: regexp_matches(host, '(^|[.-])' || w || '([.-]|$)'))) AS pattern_rule
  FROM p),
q AS (
  SELECT page_id, host, path, pattern_rule,
         CASE WHEN ends_with(d, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN ends_with(d, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN ends_with(d, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN ends_with(d, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN ends_with(d, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM r)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN pattern_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       pattern_rule
FROM q
""",
    "op9_decontam": rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, string_split_regex(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS gaps,
         regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT DISTINCT item_id,
         regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
dw AS (
  SELECT k, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT k, i, n, item_id FROM dw JOIN bw USING (n, s)),
u AS (SELECT DISTINCT k, pos FROM (SELECT k, unnest(range(i, i + n)) AS pos FROM m)),
h AS (SELECT k, count(*) AS n_hit FROM u GROUP BY k),
g AS (SELECT k, min(pos) AS a, max(pos) AS b FROM (SELECT k, pos, pos - row_number() OVER (PARTITION BY k ORDER BY pos) AS run FROM u) GROUP BY k, run),
c AS (
  SELECT k, string_agg(f || '-' || t, ',' ORDER BY f) AS spans
  FROM (SELECT k, CAST(list_sum(list_transform(gaps[1:a], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:a - 1], lambda x: length(x))), 0) AS BIGINT) AS f,
               CAST(list_sum(list_transform(gaps[1:b], lambda x: length(x))) + list_sum(list_transform(w[1:b], lambda x: length(x))) AS BIGINT) AS t
        FROM g JOIN d USING (k))
  GROUP BY k),
t AS (
  SELECT k, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256
  FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS s FROM m WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN h USING (k) LEFT JOIN t USING (k) LEFT JOIN c USING (k)
""",
    "op11_chat": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, md5(text))) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(16 + length(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '>', '%3E')) + length(regexp_replace(text, '<(\\*/?turn)', '<\\\1', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
""",
    "op13_centroids": f"""
WITH v AS (
  SELECT vec_id, row_number() OVER () AS k, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
a AS MATERIALIZED (SELECT * FROM v),
c0 AS (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x
  FROM (SELECT sha256('1:' || vec_id) AS h, x FROM a WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT 16)),
{_centroid_rounds(3)},
i AS (SELECT j, CAST(sum(d) AS BIGINT) AS own FROM n4 GROUP BY j)
SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, own AS cluster_inertia,
       (SELECT CAST(sum(d) AS BIGINT) FROM n4) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM n4 JOIN a USING (k) JOIN i USING (j) JOIN c3 AS c USING (j)
""",
}
