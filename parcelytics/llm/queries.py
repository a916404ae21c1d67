"""One registered query per operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelytics.llm import (
    alignment, embed_dedup, fill_middle, hilbert, html_blocks, licenses, media, mixing, ngram_jaccard, pieces, secrets, substrings, toxicity,
)
from parcelytics.session import freeze

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def piece_model_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_jaccard.jaccard_join(_table(spark, folder, "documents"))


# Classes by a recursive walk over the links between different texts; a class has the smallest doc_id it holds.
ORACLES["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS words FROM documents
), reps AS (
  SELECT text, min(doc_id) AS rep, count(*) AS copies, any_value(words) AS words FROM w GROUP BY text
), sh AS (
  SELECT DISTINCT rep, shingle FROM (
    SELECT rep, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
      ELSE [array_to_string(words[i:i+4], ' ') FOR i IN range(1, len(words) - 3)] END) AS shingle FROM reps)
), n AS (SELECT rep, count(*) AS n FROM sh GROUP BY rep
), common AS (
  SELECT a.rep AS x, b.rep AS y, count(*) AS k FROM sh a JOIN sh b ON a.shingle = b.shingle AND a.rep <> b.rep GROUP BY ALL
), link AS (
  SELECT x, y FROM common JOIN n p ON x = p.rep JOIN n q ON y = q.rep WHERE k >= 0.8 * (p.n + q.n - k) - 1e-9
), reach AS (
  SELECT rep AS node, rep AS root FROM reps UNION SELECT l.y, r.root FROM reach r JOIN link l ON l.x = r.node
), class AS (SELECT node, min(root) AS class_id FROM reach GROUP BY node
), degree AS (SELECT x, sum(copies) AS links FROM link JOIN reps ON y = rep GROUP BY x)
SELECT doc_id, CASE WHEN len(w.words) = 0 THEN doc_id ELSE class_id END AS class_id,
  CAST(CASE WHEN len(w.words) = 0 THEN 0 ELSE copies - 1 + coalesce(links, 0) END AS BIGINT) AS n_links,
  len(w.words) = 0 OR doc_id = class_id AS kept
FROM w JOIN reps USING (text) JOIN class ON node = rep LEFT JOIN degree ON x = rep
"""


@query
def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    path = piece_model_path()
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    done = pieces.encode_decode(docs, path)
    return done.select("doc_id", pieces.n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.toxicity(_table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query
def op2_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    slim = docs.select(
        "doc_id", "source", "lang", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    cells = [hilbert.by_name(F.col("source")), hilbert.by_name(F.col("lang")), hilbert.by_size(F.col("size"))]
    # rows of one place follow their id; the other columns only order rows that have no id or share one
    out = hilbert.curve_shards(slim, cells, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


@query
def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(_table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["rank"] < len(secrets.BASE))
    counts = [secrets.count_of(F.col("secrets"), k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("secrets")).alias("spans"))


@query
def op6_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    out = mixing.with_copies(_table(spark, folder, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "copies")


# The level at which the shares stop rising: sources in order of cap per weight, the first k at their caps.
ORACLES["op6_source_mix"] = r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s GROUP BY source
), ordered AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
    sum(3.0::DOUBLE * source_size) OVER w AS capped, sum(weight) OVER w AS used, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM per WINDOW w AS (ORDER BY 3.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), levels AS (
  SELECT CAST(any_value(total) AS DOUBLE) / CAST(any_value(weights) AS DOUBLE) AS level FROM ordered
  UNION ALL SELECT (CAST(total AS DOUBLE) - capped) / CAST(weights - used AS DOUBLE) FROM ordered WHERE weights > used
), top AS (SELECT max(level) AS level FROM levels
), t AS (
  SELECT source, source_size, least(weight * level, cap) AS target, CASE WHEN source_size > 0 THEN least(weight * level, cap) / source_size ELSE 0.0 END AS rate
  FROM ordered CROSS JOIN top
), c AS (
  SELECT doc_id, size, source_size, target, s.source,
    CAST(floor(rate) AS BIGINT) + CASE WHEN CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS copies
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, source, CAST(copies AS BIGINT) AS copies FROM c
"""


@query
def op8_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embed_dedup.cosine_links(_table(spark, folder, "embeddings"))


ORACLES["op8_embedding_near_dedup"] = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
    label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
      AND len([x FOR x IN embedding IF x <> 0]) > 0 AS good
  FROM embeddings
), link AS (
  SELECT a.rid AS x, b.rid AS y FROM v a JOIN v b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e) AND a.good AND b.good
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.93
), reach AS (SELECT rid AS node, rid AS other FROM v UNION SELECT l.y, r.other FROM reach r JOIN link l ON l.x = r.node
), c AS (SELECT node, min(v.vec_id) AS component_id FROM reach JOIN v ON v.rid = other GROUP BY node
), n AS (SELECT x, count(*) AS k FROM link GROUP BY x)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON node = rid LEFT JOIN n ON x = rid
"""


@query
def op5_media_columns(spark: SparkSession, folder: str) -> DataFrame:
    kept = media.stored_texts(_table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).cast("long").alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.col("dhash").alias("feature"), F.sha2("tile", 256).alias("tile_sha256"),
    )


@query
def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(_table(spark, folder, "documents").select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"])))
    shown = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"), F.format_number(x["dice"], 4)))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_passages"), F.array_join(names, ",").alias("licenses"),
        F.array_max(F.transform("licenses", lambda x: x["dice"])).alias("best_dice"), F.array_join(shown, ",").alias("passages"),
    )


@query
def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", "url", "html")
    out = html_blocks.main_text(pages, html_blocks.fit(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    vocabularies = public_tokenizers.path("byte_bpe_50k.json"), piece_model_path()
    aligned = alignment.align(_table(spark, folder, "documents").select("doc_id", "text"), *vocabularies)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    slim = freeze(aligned.select("doc_id", "n_a", "n_b", "links", digest))  # tokenized once, counted and scored from there
    out = alignment.with_scores(slim, alignment.pair_counts(slim))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query
def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    out = fill_middle.restore(fill_middle.transform(_table(spark, folder, "documents").select("doc_id", "text")))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLES["op12_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS unit,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), c AS (
  SELECT *, len(unit) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(unit) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(unit) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), b AS (
  SELECT *, array_to_string(unit[1:least(x, y)], '') AS prefix, array_to_string(unit[least(x, y) + 1:greatest(x, y)], '') AS middle,
    array_to_string(unit[greatest(x, y) + 1:], '') AS suffix
  FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM b
"""


@query
def op13_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = substrings.remove_repeats(_table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op13_substring_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT rid, doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k, unnest([
    CASE WHEN i + 49 <= len(words) THEN array_to_string(words[i:i + 49], ' ') END FOR i IN range(1, len(words) + 1)]) AS seen
  FROM d
), least_id AS (SELECT seen, min(doc_id) AS first_id FROM w WHERE seen IS NOT NULL AND doc_id IS NOT NULL GROUP BY seen
), hit AS (
  SELECT w.rid, w.k, w.word, CASE WHEN l.first_id < w.doc_id THEN w.k END AS begins FROM w LEFT JOIN least_id l ON l.seen = w.seen
), covered AS (
  SELECT rid, k, word, coalesce(max(begins) OVER (PARTITION BY rid ORDER BY k) >= k - 49, false) AS gone FROM hit
), per AS (
  SELECT rid, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (WHERE NOT gone) AS kept FROM covered GROUP BY rid
)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN per USING (rid)
"""
