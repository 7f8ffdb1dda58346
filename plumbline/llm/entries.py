"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import warc

    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_jaccard_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import jaccard

    return jaccard.links(table(spark, sf_dir, "documents"))


def op3_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import quality

    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import sharding

    dealt = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import embeddings

    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import wavelet

    return wavelet.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_licence_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import licenses

    docs = table(spark, sf_dir, "documents")
    found = licenses.scan(docs, licenses.train(docs))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"]))), ",")
    return found.select("doc_id", "n_paragraphs", F.size("licences").cast("long").alias("n_licences"), families.alias("families"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import repeats

    return repeats.removed(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import decontam

    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {f.__name__: f for f in (op1_warc_dictionary, op2_jaccard_rtree, op3_quality_trees, op4_histogram_sharding, op5_embedding_near_duplicates, op6_wavelet_tokens, op7_licence_paragraphs, op8_best_fit_packing, op9_suffix_repeats, op10_decontamination)}

SQL: dict[str, str] = {}

SQL["op1_warc_dictionary"] = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (SELECT payload_digest, max(page_id) AS latest FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < latest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < latest THEN latest END AS refers_to
FROM p JOIN g USING (payload_digest)
"""

SQL["op2_jaccard_rtree"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
sides AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(node, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT node, b FROM reach JOIN sides ON other = a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(other) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN reach ON node = d.doc_id GROUP BY 1, 2
"""

SQL["op9_suffix_repeats"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, substring(x, 2 * p + 1, 100) AS s FROM d, unnest(range(0, n - 49)) AS u(p) WHERE n >= 50),
g AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(*) > 1),
hit AS (SELECT w.doc_id, w.p, w.p - row_number() OVER (PARTITION BY w.doc_id ORDER BY w.p) AS run FROM w JOIN g USING (s) WHERE g.least < w.doc_id),
part AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM hit GROUP BY doc_id, run),
new AS (SELECT doc_id, a, b, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS first FROM part),
numbered AS (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY a) AS k FROM new),
span AS (SELECT doc_id, k, min(a) AS a, max(b) AS b FROM numbered GROUP BY doc_id, k),
pieces AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) AS back FROM span),
kept AS (
  SELECT p.doc_id, sum(p.b - p.a) AS gone, count(*) AS spans,
         string_agg(substring(d.x, 2 * p.last + 1, 2 * (p.a - p.last)), '' ORDER BY p.a) || max(CASE WHEN p.back = 1 THEN substring(d.x, 2 * p.b + 1) ELSE '' END) AS rest
  FROM pieces p JOIN d USING (doc_id) GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(k.gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k.rest, d.x))) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""

SQL["op10_decontamination"] = r"""
WITH item_words AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM item_words, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), sizes AS (SELECT DISTINCT n FROM windows),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM doc_words, sizes, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n
), found AS (
  SELECT d.doc_id, d.n, d.i, x.item_id FROM doc_windows d JOIN windows x ON d.n = x.n AND d.win = x.win
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, coalesce(t.items_sha256, sha256('')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hits h USING (doc_id) LEFT JOIN items t USING (doc_id)
"""
