"""Registered queries of the operators of this subpackage, and their DuckDB SQL.

Each query applies its operator, with production parameters, to its whole table.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variantlake.llm import (
    chat_trees,
    heap_clusters,
    kd_sharding,
    language_id,
    line_quality,
    mixing,
    ngram_join,
    packing,
    secret_scan,
    spelling,
    topk_search,
    url_filter,
    warc_derive,
)
from variantlake.llm.common import python_ready, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

N_SHARDS = 40
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return add


@query("op1_ngram_jaccard_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate class and link counts (five-word n-grams, 0.8)."""
    joined = ngram_join.ngram_join(table(spark, sf_dir, "documents"))
    return joined.select("doc_id", "class_id", "n_links", "n_text_links")


@query("op2_kd_tree_shards")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes, split over id, length, source and language."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    crc = F.coalesce(F.crc32(F.col("text")), F.lit(0)).cast("long")
    dims = [F.col("doc_id"), F.length("text"), F.col("source"), F.col("lang")]
    shards = kd_sharding.kd_shards(table(spark, sf_dir, "documents"), size=size, dims=dims, n_shards=N_SHARDS,
                                   keep={"doc_id": F.col("doc_id"), "size": size, "text_crc32": crc})
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op3_secret_worklist")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text, in it and in its encoded layers."""
    python_ready(spark)
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", secret_scan.findings(F.col("text")).alias("f")).select("doc_id", "f.*")


OP4_SQL = r"""
WITH src AS (
  SELECT page_id, url, coalesce(html, '') AS payload,
         md5('response|' || coalesce('=' || CAST(page_id AS VARCHAR), '') || '|' || coalesce('=' || url, '') || '|=sha256:' || sha256(coalesce(html, ''))) AS h FROM pages),
resp AS (
  SELECT page_id, url AS target_uri, payload,
         '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' AS refers_to,
         'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(payload)) AS http_headers,
         'sha256:' || sha256(payload) AS payload_digest,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(payload,
           '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'),
           '(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>', chr(10), 'g'),
           '<[!/?a-zA-Z][^>]*>', '', 'g') AS t0 FROM src),
text AS (
  SELECT *, regexp_replace(regexp_replace(
      replace(replace(replace(replace(replace(replace(t0, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&'),
      ' *\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+\z', '', 'g') AS txt,
    md5('metadata|=' || refers_to) AS mh, md5('conversion|=' || refers_to) AS ch FROM resp),
ids AS (
  SELECT *, '<urn:uuid:' || mh[1:8] || '-' || mh[9:12] || '-' || mh[13:16] || '-' || mh[17:20] || '-' || mh[21:32] || '>' AS mid,
         '<urn:uuid:' || ch[1:8] || '-' || ch[9:12] || '-' || ch[13:16] || '-' || ch[17:20] || '-' || ch[21:32] || '>' AS cid FROM text),
recs AS (
  SELECT page_id, 'conversion' AS record_type, cid AS record_id, refers_to, target_uri, http_headers, payload_digest,
         'text/plain; charset=utf-8' AS content_type, txt AS block FROM ids
  UNION ALL
  SELECT page_id, 'metadata', mid, refers_to, target_uri, http_headers, payload_digest, 'application/warc-fields',
         'source-record-id: ' || refers_to || chr(13) || chr(10) || 'source-payload-digest: ' || payload_digest || chr(13) || chr(10)
         || 'source-http-headers: ' || replace(http_headers, chr(13) || chr(10), ' | ') || chr(13) || chr(10)
         || 'conversion-record-id: ' || cid || chr(13) || chr(10) || 'conversion-block-digest: sha256:' || sha256(txt) || chr(13) || chr(10)
         || 'conversion-words: ' || len(regexp_extract_all(txt, '[^ \n]+')) || chr(13) || chr(10) FROM ids)
SELECT page_id, record_type, record_id, refers_to, target_uri, '2024-01-01T00:00:00Z' AS date, http_headers, payload_digest, content_type,
       CAST(octet_length(encode(block)) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest, block FROM recs
"""


@query("op4_warc_derivatives", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    return warc_derive.derive(warc_derive.responses(table(spark, sf_dir, "pages")), keep=["page_id"])


OP5_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
ws AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
wp AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM ws),
tri AS (SELECT rid, i, word AS a, lead(word) OVER p AS b, lead(word, 2) OVER p AS c FROM wp WINDOW p AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri WHERE c IS NOT NULL) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + d) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS o(d) GROUP BY rid),
ls AS (SELECT rid, source, unnest(string_split(t, chr(10))) AS line FROM docs),
lw AS (SELECT rid, source, line, regexp_replace(lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')), '[0-9]+', '0', 'g') AS norm,
              len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM ls WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw GROUP BY rid),
hosts AS (SELECT source, count(*) AS n_docs FROM docs GROUP BY source),
freq AS (SELECT lw.source, norm FROM lw JOIN hosts ON lw.source IS NOT DISTINCT FROM hosts.source
         GROUP BY lw.source, norm, n_docs HAVING count(DISTINCT rid) > 100 OR (count(DISTINCT rid) > 10 AND count(DISTINCT rid) > n_docs * 0.01)),
gone AS (SELECT rid, CAST(sum(words) AS BIGINT) AS removed FROM lw JOIN freq ON lw.source IS NOT DISTINCT FROM freq.source AND lw.norm = freq.norm GROUP BY rid),
m AS (SELECT d.rid, d.doc_id, d.source AS host, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed, 0) AS n_removed_words
      FROM docs d JOIN ws USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             n_removed_words > 0 AND (n_words - n_removed_words < 20 OR n_words - n_removed_words < n_words * 0.5) AS depleted FROM m)
SELECT doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words, base_failed, depleted,
       NOT base_failed AND NOT depleted AS kept FROM v
"""


@query("op5_line_frequency_rules", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdict of every document; the source is the host."""
    return line_quality.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "depleted", "kept")


@query("op6_water_filled_mix")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: sources weigh 1, 2, 3 in turn, three epochs at most."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "reps")


OP7_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rhost, rpath, rverdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hit AS (SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS verdict
        FROM (SELECT DISTINCT page_id, host, path FROM p) JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN hit ON p.page_id IS NOT DISTINCT FROM hit.page_id AND p.host = hit.host AND p.path = hit.path
"""


@query("op7_url_prefix_rules", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL under the four rules; allowed when none fits."""
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark, URL_RULES))


@query("op8_hyperdimensional_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    learned = language_id.learn(docs.where(F.col("doc_id").isNotNull() & ~language_id.held_out()).select("text", "lang"))
    rows = docs.select("doc_id", language_id.held_out().alias("held_out"), "text")
    return language_id.identify(rows, learned).select("doc_id", "held_out", "lang_pred", "score")


OP9_SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid AS q_rid, q.vec_id AS query_id, c.rid, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.rid <> c.rid AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q_rid ORDER BY score DESC, vec_id NULLS LAST, rid) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op9_segment_topk", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every vector whose id is divisible by 20, against all rows."""
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 20 == 0, k=20)


@query("op10_dominance_best_fit")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces packed into sequences of 2,048 tokens."""
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(replace(replace(role || '|' || text, '\', '\\'), '<turn>', '<\turn>'), '<text>', '<\text>'), '</turn>', '<\/turn>')) - 1 + 20 AS chars FROM t),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) AS turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST), '') AS loss,
         CAST(sum(chars) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

MARKED = r"\### Assistant: </turn> ok"


@query("op11_reply_tree_chats", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one full of control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                   F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKED).alias("text"))
    paths = chat_trees.format_paths(chat_trees.from_turns(turns.unionByName(marked)))
    digest = lambda c: F.sha2(c, 256)
    turn = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return chat_trees.read_back(paths).select(
        F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), digest(F.array_join(F.transform("turns", turn), "")).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), digest(F.col("loss_text")).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def _clusters_sql(rounds: int = 3) -> str:
    """Rounds of assignment and update, written out; lists of components are compared whole."""
    far = "list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.c[i]) * (v.v[i] - c.c[i])))"
    parts = ["""v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS INTEGER) AS j, v AS c FROM
  (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, v FROM v ORDER BY h NULLS LAST, v LIMIT 16))"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT rid, vec_id, v, j, d FROM (SELECT v.rid, v.vec_id, v.v, c.j, {far} AS d FROM v CROSS JOIN c{i} c)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, j) = 1)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT j, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY j, i),
c{i + 1} AS MATERIALIZED (SELECT j, coalesce(m, c) AS c FROM c{i} LEFT JOIN (SELECT j, list(m ORDER BY i) AS m FROM s{i} GROUP BY j) USING (j))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, a.j AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.j = c.j"""


@query("op12_heap_bound_clusters", _clusters_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after three rounds over 16 centroids."""
    return heap_clusters.cluster(table(spark, sf_dir, "embeddings"))


@query("op13_sorted_list_spelling")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of seven letters or more that occurs twice, with its form and root."""
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents").select("doc_id", "text")))
