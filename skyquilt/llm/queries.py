"""The queries of the training-data operators, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.llm import ann, linededup, mixing, packing, pfor, quality, sharding, simhash, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def may_learn() -> F.Column:
    """Labels of the other third are held out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(_table(spark, sf_dir, "pages"), min_bytes=0)
    return warc.verified(warc.read_archives(manifest, keep_payload=False)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.Toxicity().fit(docs, _table(spark, sf_dir, "labels"), train=may_learn())
    return model.score(docs).select("doc_id", (~may_learn()).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), window=2048, end_id=1)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measured_and_judged(_table(spark, sf_dir, "documents"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.read_ids(pfor.write_ids(_table(spark, sf_dir, "documents"), end_id=0))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("spans", "text_hash")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = linededup.drop_boilerplate(docs, ratio=0.05, min_pages=3, lines_col="n_lines", dropped_col="n_dropped")
    return out.select("doc_id", "n_lines", "n_dropped", "text")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_toxicity, op3_packing, op4_quality, op5_token_ids, op6_mixing, op7_simhash, op8_line_dedup, op9_sharding, op10_ann)}


_TRIM = r"regexp_replace({}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"

OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('h' || source, 'n') AS host, text FROM documents),
l AS (SELECT r, doc_id, host, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d WHERE text IS NOT NULL),
t AS (SELECT r, doc_id, host, line, i, {_TRIM.format("line")} AS bare FROM l),
c AS (SELECT host, bare, count(DISTINCT r) AS pages FROM t WHERE bare <> '' GROUP BY host, bare),
p AS (SELECT host, count(*) AS total FROM d GROUP BY host),
b AS (SELECT c.host, c.bare FROM c JOIN p USING (host) WHERE pages >= 3 AND pages > CAST(0.05 AS DOUBLE) * total),
k AS (SELECT t.r, count(*) FILTER (t.bare <> '') AS n_lines, count(b.bare) AS n_dropped, string_agg(t.line, chr(10) ORDER BY t.i) FILTER (b.bare IS NULL) AS text
  FROM t LEFT JOIN b ON t.host = b.host AND t.bare = b.bare GROUP BY t.r)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_dropped, 0)::BIGINT AS n_dropped, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM d LEFT JOIN k USING (r)
"""

OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
w AS (SELECT r, i, list_aggregate(words[i : i + 7], 'string_agg', ' ') AS g FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) > 7)),
f AS (SELECT r, i FROM w QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
s AS (SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM f) GROUP BY r),
m AS (SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')), 0)::BIGINT AS word_chars,
  coalesce(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0)::BIGINT AS n_symbols,
  (len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
  coalesce(s.n, 0)::BIGINT AS n_repeat_words, text, words, string_split(text, chr(10)) AS lines FROM d LEFT JOIN s USING (r)),
b AS (SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR NOT word_chars BETWEEN n_words * 2 AND n_words * 16 OR n_symbols * 4 > n_words OR n_dup_lines * 10 > n_words
    OR (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) * 2 > word_chars OR (length(text) - length(regexp_replace(text, '[!?]', '', 'g'))) * 4 > n_words
    OR (length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) * 2 > word_chars OR regexp_matches(text, '[^\x20\x09-\x0D]{200}')
    OR len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) * 10 > len(lines) * 9 OR len(list_distinct(words)) * 10 < n_words) AS kept
FROM b
"""


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha1(t) AS x, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, (k // 4) * 5 + 1, 5))::INT >> (15 - 5 * (k % 4))::INT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM h
"""

#: Seats by ranking all quotients; words of a row from its place in its source's stream, without shards' carried remainders.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(concat('7/', coalesce(doc_id::VARCHAR, 'null'), '/', coalesce(md5(text), ''))) AS h FROM documents),
p AS (SELECT doc_id, source, size, ('0x' || substr(h, 1, 15))::BIGINT AS place, ('0x' || substr(h, 16, 15))::BIGINT AS lot FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM p GROUP BY source),
w AS (SELECT *, [5e0, 2e0, 1e0][(rank - 1) % 3 + 1] AS w, source_size * 2e0 AS lim, 1.5e0 * sum(source_size) OVER () AS words FROM s),
l AS (SELECT *, lim * sum(w) OVER (ORDER BY lim / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= (words - coalesce(sum(lim) OVER (ORDER BY lim / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS full_ FROM w),
t AS (SELECT *, CASE WHEN full_ THEN lim ELSE (words - coalesce(sum(lim) FILTER (full_) OVER (), 0)) / sum(w) FILTER (NOT full_) OVER () * w END AS target, greatest(1, least(64, source_size // 64)) AS unit FROM l),
b AS (SELECT *, CAST(ceil(source_size / unit) AS BIGINT) AS blocks FROM t),
q AS (SELECT rank, unit, target / (2 * k + 1) AS quotient FROM (SELECT rank, unit, target, unnest(range(0, 2 * blocks)) AS k FROM b WHERE target > 0)),
g AS (SELECT unit, CAST(floor(sum(target) / unit + 0.5) AS BIGINT) AS all_seats FROM b GROUP BY unit),
r AS (SELECT rank, count(*) AS seats FROM (SELECT rank, all_seats, row_number() OVER (PARTITION BY unit ORDER BY quotient DESC, rank) AS i FROM q JOIN g USING (unit)) WHERE i <= all_seats GROUP BY rank),
c AS (SELECT b.*, greatest(blocks, 1) AS nb, coalesce(seats, 0) AS seats FROM b LEFT JOIN r USING (rank)),
e AS (SELECT source, rank, source_size, target, unit, nb, seats // nb AS times, seats % nb AS more, ('0x' || substr(md5(concat('9/', rank::VARCHAR)), 1, 15))::BIGINT % nb AS start FROM c),
n AS (SELECT greatest(1, CAST(ceil(sum(size + 1) / 16777216) AS BIGINT)) AS shards FROM p),
f AS (SELECT doc_id, size, e.*, sum(size) OVER (PARTITION BY rank ORDER BY lot % shards, place, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS z FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source CROSS JOIN n),
k AS (SELECT *, (z - size) // unit AS k0, z // unit AS k1 FROM f)
SELECT doc_id, size, source_size, target, (times * size + CASE WHEN size > 0 THEN
  ((k1 * more + start) // nb) * unit + (((k1 + 1) * more + start) // nb - (k1 * more + start) // nb) * (z - k1 * unit)
  - ((k0 * more + start) // nb) * unit - (((k0 + 1) * more + start) // nb - (k0 * more + start) // nb) * (z - size - k0 * unit) ELSE 0 END)::BIGINT AS taken
FROM k
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op4_quality": OP4_SQL, "op6_mixing": OP6_SQL, "op8_line_dedup": OP8_SQL}
