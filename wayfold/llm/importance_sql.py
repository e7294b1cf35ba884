"""Importance resampling as DuckDB SQL."""

from __future__ import annotations

from wayfold.llm.turn_repair_sql import CRC_TABLE, crc32


def resampled_sql(buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = lambda text: f"regexp_extract_all(translate(coalesce({text}, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    grams = "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))"
    return f"""
WITH texts AS (SELECT 0 AS side, row_number() OVER () AS id, doc_id, {words("text")} AS w FROM documents UNION ALL SELECT 1, -row_number() OVER (), NULL, {words("text")} FROM benchmark),
counts AS (SELECT side, id, feature, count(*) AS n FROM (SELECT side, id, {grams} AS feature FROM texts) GROUP BY ALL),
dictionary AS (SELECT feature, {crc32("feature")} % {buckets} AS bucket FROM (SELECT DISTINCT feature FROM counts), {CRC_TABLE} t),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM counts JOIN dictionary USING (feature) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + {buckets}) / ((s + 1) * ((SELECT sum(t) FROM sums) + {buckets}))))::BIGINT AS gain FROM sums),
means AS (SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM counts JOIN dictionary USING (feature) JOIN gains USING (bucket) WHERE side = 0 GROUP BY id),
scores AS (
  SELECT x.id, doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, len(w) >= {least_words} AS enough,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || left(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM texts x LEFT JOIN means m ON x.id = m.id WHERE side = 0),
places AS (SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= (SELECT count(*) FROM scores WHERE enough) * {percent} // 100 THEN place END AS rank FROM places"""
